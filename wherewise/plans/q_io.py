"""Queries of sources and sinks, exports, streams and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import r9
from ..operators import resolver
from ..sources import files
from ..sources.files import scratch
from ..streaming import events as S
from . import oracle as O
from .catalog import query
from .fixtures import Tables
from .q_bench import items
from .q_resolver import _BEST, scored


@query("src_scene_cache", "SELECT scene_id, id, label, cx, hz FROM fx_objects")
def src_scene_cache(x: Tables) -> DataFrame:
    """Scenes written by sink_scene_cache and read again."""
    path = scratch(x.spark)
    files.write_scenes({"objects": x.objects}, path)
    return files.read_scenes(x.spark, path, "objects").select(F.col("scene_id").cast("long").alias("scene_id"), "id", "label", "cx", "hz")


@query("sink_scene_cache", "SELECT scene_id, count(*) AS points FROM fx_points GROUP BY scene_id")
def sink_scene_cache(x: Tables) -> DataFrame:
    path = scratch(x.spark)
    files.write_scenes({"points": x.points}, path)
    return files.read_scenes(x.spark, path, "points").groupBy(F.col("scene_id").cast("long").alias("scene_id")).agg(F.count("*").alias("points"))


@query("cache_catalog", "SELECT concat('fixture__', scene_id) AS scene_key, count(*) AS n_objects, FALSE AS stale FROM fx_objects GROUP BY scene_id")
def cache_catalog(x: Tables) -> DataFrame:
    c = files.catalog(x.objects.withColumn("schema_version", F.lit(files.SCHEMA_VERSION)))
    return c.select(files.scene_key(F.lit("fixture"), F.col("scene_id").cast("string")).alias("scene_key"), "n_objects", "stale")


@query("src_items_jsonl", "SELECT concat('q', query_id) AS id, CAST(scene_id AS VARCHAR) AS scene_id, text FROM fx_utterances")
def src_items_jsonl(x: Tables) -> DataFrame:
    """Items through JSON lines, with a comment and blank lines between."""
    path = scratch(x.spark)
    rows = x.utterances.select(F.concat(F.lit("q"), "query_id").alias("id"), F.col("scene_id").cast("string").alias("scene_id"), "text")
    extra = x.spark.createDataFrame([("",), ("// a comment",), ("# another",)], "value string")
    rows.select(F.to_json(F.struct("*")).alias("value")).union(extra).write.text(path)
    return files.read_items(x.spark, path).select("id", "scene_id", "text")


@query("sink_items_jsonl", "SELECT concat('q', query_id) AS id, relation_type FROM fx_utterances")
def sink_items_jsonl(x: Tables) -> DataFrame:
    path = scratch(x.spark)
    files.write_json_lines(x.utterances.select(F.concat(F.lit("q"), "query_id").alias("id"), "relation_type"), path)
    return x.spark.read.schema("id string, relation_type string").json(path)


@query("src_items_many", "SELECT count(*) AS items FROM (SELECT query_id FROM fx_utterances UNION ALL SELECT -1 - query_id FROM fx_utterances_rich) i")
def src_items_many(x: Tables) -> DataFrame:
    """Files read together; an id in two of them is an error."""
    a, b = scratch(x.spark), scratch(x.spark)
    files.write_json_lines(x.utterances.select(F.concat(F.lit("q"), "query_id").alias("id"), "text"), a)
    files.write_json_lines(x.rich.select(F.concat(F.lit("r"), "query_id").alias("id"), "text"), b)
    return files.read_items(x.spark, a, b).agg(F.count("*").alias("items"))


@query("src_pairs_jsonl", "SELECT query_id AS id, target AS a, anchor AS b FROM fx_utterances")
def src_pairs_jsonl(x: Tables) -> DataFrame:
    path = scratch(x.spark)
    files.write_json_lines(x.utterances.select(F.col("query_id").alias("id"), F.struct(F.col("target").alias("a"), F.col("anchor").alias("b")).alias("arms")), path)
    return x.spark.read.schema("id long, arms struct<a:string,b:string>").json(path).select("id", "arms.a", "arms.b")


@query("src_config_yaml", "SELECT 55.0E0 AS cone_half_angle_deg, 0.08E0 AS contact_tol, 1.25E0 AS comparative_full")
def src_config_yaml(x: Tables) -> DataFrame:
    return files.config_table(x.spark).select("cone_half_angle_deg", "contact_tol", "comparative_full")


@query("src_ply", "SELECT scene_id, count(*) AS vertices, round(sum(x), 6) AS sx FROM fx_points GROUP BY scene_id")
def src_ply(x: Tables) -> DataFrame:
    """Points through PLY files and back."""
    from ..sources.files import parse_ply

    def run(frames):
        import pandas as pd

        for f in frames:
            for scene, data in zip(f["scene_id"], f["content"], strict=True):
                p, _, _ = parse_ply(data)
                yield pd.DataFrame({"scene_id": [scene], "vertices": [len(p)], "sx": [round(float(p[:, 0].sum()), 6)]})

    return files.ply_files(x.points).mapInPandas(run, "scene_id long, vertices long, sx double")


@query("sink_ply", None)
def sink_ply(x: Tables) -> DataFrame:
    return files.ply_files(x.points).select("scene_id", F.octet_length("content").alias("bytes"))


@query("sink_results", None)
def sink_results(x: Tables) -> DataFrame:
    """Outcomes written by condition and read back."""
    path = scratch(x.spark)
    x.outcomes.write.partitionBy("condition_key").parquet(path)
    return x.spark.read.parquet(path).groupBy("condition_key").agg(F.count("*").alias("n"))


@query("scene_payload", "SELECT scene_id, count(*) AS objects FROM fx_objects GROUP BY scene_id")
def scene_payload(x: Tables) -> DataFrame:
    p = files.scene_payload(x.objects, x.poses)
    return p.select("scene_id", F.size(F.from_json("payload", "objects array<struct<id:long>>")["objects"]).cast("long").alias("objects"))


@query("src_synthetic_benchmark", "SELECT o.scene_id, v.name, o.id FROM (VALUES ('a', 'gear', 1.0E0, 1.0E0), ('b', 'plate', 3.0E0, 2.0E0), ('c', 'bolt', 0.0E0, 5.0E0)) AS v(name, label, x, y) JOIN fx_objects o ON o.label = v.label QUALIFY row_number() OVER (PARTITION BY o.scene_id, v.name ORDER BY round((o.cx - v.x) * (o.cx - v.x) + (o.cy - v.y) * (o.cy - v.y), 9), o.id) = 1")
def src_synthetic_benchmark(x: Tables) -> DataFrame:
    """Items located by class and nearest position."""
    v = x.spark.createDataFrame([("a", "gear", 1.0, 1.0), ("b", "plate", 3.0, 2.0), ("c", "bolt", 0.0, 5.0)], "name string, label string, x double, y double")
    d = F.round((F.col("cx") - F.col("x")) ** 2 + (F.col("cy") - F.col("y")) ** 2, 9)
    return x.objects.join(v, "label").groupBy("scene_id", "name").agg(F.min_by("id", F.struct(d.alias("d"), "id")).alias("id"))


@query("resolution_export", f"WITH {scored()},{_BEST.rstrip()} SELECT query_id, least(count(*), 12) AS listed, {O.r9('max(score)')} AS top FROM r GROUP BY query_id")
def resolution_export(x: Tables) -> DataFrame:
    """Each query's answer as JSON with its 12 best candidates."""
    rows = resolver.ranked(resolver.combine(resolver.best_anchor(resolver.scored_pairs(x.utterances, x.objects, x.rooms))))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("rank", F.col("target_id").alias("id"), "score"))), 1, 12)
    out = rows.groupBy("query_id").agg(F.to_json(F.struct(listed.alias("candidates"))).alias("json"))
    back = F.from_json("json", "candidates array<struct<rank:int,id:long,score:double>>")["candidates"]
    return out.select("query_id", F.size(back).cast("long").alias("listed"), r9(F.get(back, F.lit(0))["score"]).alias("top"))


@query("support_pick", "SELECT query_id, relation IN ('on', 'inside', 'above') AS counts_along_support FROM fx_utterances")
def support_pick(x: Tables) -> DataFrame:
    return x.utterances.select("query_id", F.col("relation").isin("on", "inside", "above").alias("counts_along_support"))


@query("amb_report", f"WITH {scored()},{_BEST.rstrip()} SELECT query_id, concat_ws(',', CASE WHEN score < 0.12E0 THEN 'weak_match' END, CASE WHEN (score > 1e-9 AND score - second <= greatest(0.04E0, 0.08E0 * score)) IS TRUE THEN 'score_tie' END) AS kinds FROM r WHERE rank = 1")
def amb_report(x: Tables) -> DataFrame:
    """All flags of a query, in order, as one array."""
    rows = resolver.resolve(x.utterances, x.objects, x.rooms)
    kinds = F.array_compact(F.array(F.when(F.col("weak_match"), "weak_match"), F.when(F.col("score_tie"), "score_tie")))
    return rows.select("query_id", F.array_join(F.array_distinct(kinds), ",").alias("kinds"))


@query("rob_perturb", None)
def rob_perturb(x: Tables) -> DataFrame:
    """Twenty jittered configurations: thresholds log-uniformly around their defaults, shares clipped, orders kept."""
    return resolver.trial_table(x.spark)


@query("udf_surface", None)
def udf_surface(x: Tables) -> DataFrame:
    """A parser of the caller's own in place of the rules."""
    from ..operators import parsing

    def shout(frames):
        for f in frames:
            yield f.assign(target=f["text"].str.split().str[1], words=f["text"].str.split().str.len())[["text", "target", "words"]]

    return parsing.with_parser(x.utterances.select("query_id", "text"), shout, "text string, target string, words long")


# streams --------------------------------------------------------------------------------------------------------------------------


@query("ext_stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_stream_tumbling(x: Tables) -> DataFrame:
    return S.run(S.tumbling(S.stream(x.spark, x.sf_dir)))


@query("ext_stream_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * k FOR k IN range(0, 4)]) AS start FROM events) s GROUP BY start")
def ext_stream_sliding(x: Tables) -> DataFrame:
    return S.run(S.sliding(S.stream(x.spark, x.sf_dir)))


@query("ext_stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, sid")
def ext_stream_session(x: Tables) -> DataFrame:
    return S.run(S.sessions(S.stream(x.spark, x.sf_dir)))


@query("ext_stream_latest", "SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS latest FROM events GROUP BY user_id")
def ext_stream_latest(x: Tables) -> DataFrame:
    return S.run(S.latest(S.stream(x.spark, x.sf_dir)))


_NOON = "2024-01-16 12:00:00"


@query("ext_stream_late", f"WITH e AS (SELECT ts, date_trunc('hour', ts) AS start, coalesce(event_type, '') <> 'click' AND ts <= TIMESTAMP '{_NOON}' AS early FROM events), m AS (SELECT max(ts) - INTERVAL '10 minutes' AS mark FROM e WHERE early) SELECT start, count(*) AS n FROM e, m WHERE ts IS NOT NULL AND (early OR mark IS NULL OR start + INTERVAL '1 hour' > mark) GROUP BY start")
def ext_stream_late(x: Tables) -> DataFrame:
    """Events in two arrivals: first what came before noon of a day, but for clicks; then the rest. Clicks of hours that the watermark has passed are dropped."""
    e = x.source("events")
    early = F.coalesce((F.coalesce("event_type", F.lit("")) != "click") & (F.col("ts") <= F.lit(_NOON).cast("timestamp_ntz")), F.lit(False))
    hours = lambda events: S.timed(events).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(S.start_of("window"), "n")
    updates = S.arrivals([e.where(early), e.where(~early)], hours)
    return updates.groupBy("start").agg(F.max("n").alias("n"))


# views ----------------------------------------------------------------------------------------------------------------------------


@query("viz_best_joint_view", f"WITH c AS (SELECT p.scene_id, p.idx, u.target, min(((o.cx - p.ex) * p.fwd_x + (o.cy - p.ey) * p.fwd_y) / nullif(sqrt((o.cx - p.ex) * (o.cx - p.ex) + (o.cy - p.ey) * (o.cy - p.ey) + (o.cz - p.ez) * (o.cz - p.ez)), 0)) AS worst FROM fx_poses p JOIN fx_objects o ON o.scene_id = p.scene_id JOIN (SELECT DISTINCT scene_id, target FROM fx_utterances) u ON u.scene_id = o.scene_id AND u.target = o.label GROUP BY p.scene_id, p.idx, u.target) SELECT scene_id, target, {O.r9('max(worst)')} AS worst FROM c GROUP BY scene_id, target")
def viz_best_joint_view(x: Tables) -> DataFrame:
    """For each class the pose that shows its worst-seen object best."""
    u = x.utterances.select("scene_id", F.col("target").alias("label")).distinct()
    dx, dy, dz = F.col("cx") - F.col("ex"), F.col("cy") - F.col("ey"), F.col("cz") - F.col("ez")
    axis = (dx * F.col("fwd_x") + dy * F.col("fwd_y")) / F.nullif(F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(0.0))
    worst = x.objects.join(u, ["scene_id", "label"]).join(x.poses, "scene_id").groupBy("scene_id", "idx", F.col("label").alias("target")).agg(F.min(axis).alias("worst"))
    return worst.groupBy("scene_id", "target").agg(r9(F.max("worst")).alias("worst"))


@query("viz_depth_buffer", "SELECT p.scene_id, p.idx, CAST(floor((320 + 500 * s / d) / 16) AS BIGINT) AS px, round(min(d), 9) AS depth FROM (SELECT q.scene_id, p.idx, (q.x - p.ex) * p.fwd_x + (q.y - p.ey) * p.fwd_y AS d, (q.x - p.ex) * p.fwd_y - (q.y - p.ey) * p.fwd_x AS s FROM fx_points q JOIN fx_poses p ON p.scene_id = q.scene_id) p WHERE d > 0.1E0 GROUP BY 1, 2, 3")
def viz_depth_buffer(x: Tables) -> DataFrame:
    """Nearest depth of each column of each pose's picture."""
    rows = x.points.join(x.poses, "scene_id")
    d = (F.col("x") - F.col("ex")) * F.col("fwd_x") + (F.col("y") - F.col("ey")) * F.col("fwd_y")
    s = (F.col("x") - F.col("ex")) * F.col("fwd_y") - (F.col("y") - F.col("ey")) * F.col("fwd_x")
    rows = rows.select("scene_id", "idx", d.alias("d"), s.alias("s")).where("d > 0.1")
    return rows.groupBy("scene_id", "idx", F.floor((320 + 500 * F.col("s") / F.col("d")) / 16).alias("px")).agg(F.round(F.min("d"), 9).alias("depth"))


@query("cli_find_gif", f"SELECT u.query_id, {O.r9('max(o.cx) - min(o.cx)')} AS spread FROM fx_utterances u JOIN fx_objects o ON o.scene_id = u.scene_id AND o.label = u.target WHERE u.relation_type LIKE 'projective%' GROUP BY u.query_id HAVING max(o.cx) - min(o.cx) <= 5.5E0")
def cli_find_gif(x: Tables) -> DataFrame:
    """Direction phrases whose candidates lie close enough together for one picture."""
    rows = x.utterances.where(F.col("relation_type").startswith("projective")).join(x.objects.withColumnRenamed("label", "target"), ["scene_id", "target"])
    spread = rows.groupBy("query_id").agg((F.max("cx") - F.min("cx")).alias("spread"))
    return spread.where("spread <= 5.5").select("query_id", r9(F.col("spread")).alias("spread"))
