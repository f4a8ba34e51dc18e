"""Queries of helpers, reports, views and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clip, gmean, r9, ramp
from ..operators import evaluation as E
from ..operators import masks, probes, reports, resolver
from ..sources import files
from . import oracle as O
from .catalog import query
from .fixtures import Tables
from .q_bench import N, n_if, outcomes

_X = "CAST(p_partkey % 100 AS DOUBLE) / 40"


@query("rel_helpers", f"SELECT p_partkey AS k, {O.r9(O.ramp(_X, '0.5E0', '1.5E0'))} AS ramp, {O.r9('1.0E0 - ' + O.ramp(_X, '0.5E0', '1.5E0'))} AS falloff, {O.r9(O.gmean([_X, '0.5E0'], [1, 0.5]))} AS gmean FROM part")
def rel_helpers(x: Tables) -> DataFrame:
    v = (F.col("p_partkey") % 100).cast("double") / 40
    return x.source("part").select(F.col("p_partkey").alias("k"), r9(ramp(v, 0.5, 1.5)).alias("ramp"), r9(1.0 - ramp(v, 0.5, 1.5)).alias("falloff"), r9(gmean([v, F.lit(0.5)], [1.0, 0.5])).alias("gmean"))


@query(
    "front_cue_visibility",
    f"SELECT o.scene_id, o.id, d.k AS side, {O.r9('avg(greatest(0.0E0, ((p.ex - o.cx) * (d.sx * o.ux - d.sy * o.uy) + (p.ey - o.cy) * (d.sx * o.uy + d.sy * o.ux)) / greatest(1e-9, sqrt((p.ex - o.cx) * (p.ex - o.cx) + (p.ey - o.cy) * (p.ey - o.cy)))))')} AS seen FROM fx_objects o CROSS JOIN (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) AS d(k, sx, sy) JOIN fx_poses p ON p.scene_id = o.scene_id GROUP BY o.scene_id, o.id, d.k",
)
def front_cue_visibility(x: Tables) -> DataFrame:
    """How squarely poses look at each face; a diagnostic."""
    from ..operators import fronts

    rows = fronts.faces(x.objects).join(x.poses, "scene_id")
    vx, vy = F.col("ex") - F.col("cx"), F.col("ey") - F.col("cy")
    toward = (vx * F.col("dx") + vy * F.col("dy")) / F.greatest(F.lit(1e-9), F.sqrt(vx * vx + vy * vy))
    return rows.groupBy("scene_id", "id", "side").agg(r9(F.avg(F.greatest(F.lit(0.0), toward))).alias("seen"))


_DX, _DY, _DZ = "(q.x - p.ex)", "(q.y - p.ey)", "(q.z - p.ez)"
_SEEN = f"sqrt({_DX} * {_DX} + {_DY} * {_DY} + {_DZ} * {_DZ}) > 0.25E0 AND {_DX} * p.fwd_x + {_DY} * p.fwd_y > sqrt({_DX} * {_DX} + {_DY} * {_DY} + {_DZ} * {_DZ}) * 0.5E0"


@query("clip_views", f"SELECT scene_id, id, CAST(count_if(share >= 0.5E0) AS BIGINT) AS good_views, {O.r9('max(share)')} AS best FROM (SELECT q.scene_id, q.id, p.idx, avg(CASE WHEN {_SEEN} THEN 1.0E0 ELSE 0.0E0 END) AS share FROM fx_points q JOIN fx_poses p ON p.scene_id = q.scene_id GROUP BY q.scene_id, q.id, p.idx) v GROUP BY scene_id, id")
def clip_views(x: Tables) -> DataFrame:
    """The share of each object's points that poses see."""
    v = reports.visible_share(x.points, x.poses)
    return v.groupBy("scene_id", "id").agg(F.count_if(F.col("share") >= 0.5).alias("good_views"), r9(F.max("share")).alias("best"))


@query("viz_visibility", f"SELECT scene_id, idx, {n_if('share > 0')} AS objects_in_view FROM (SELECT q.scene_id, q.id, p.idx, avg(CASE WHEN {_SEEN} THEN 1.0E0 ELSE 0.0E0 END) AS share FROM fx_points q JOIN fx_poses p ON p.scene_id = q.scene_id GROUP BY q.scene_id, q.id, p.idx) v GROUP BY scene_id, idx")
def viz_visibility(x: Tables) -> DataFrame:
    return reports.visible_share(x.points, x.poses).groupBy("scene_id", "idx").agg(F.count_if(F.col("share") > 0).alias("objects_in_view"))


@query("viz_poster_view", None)
def viz_poster_view(x: Tables) -> DataFrame:
    """The pose that composes each scene best."""
    s = reports.visible_share(x.points, x.poses).groupBy("scene_id", "idx").agg(F.avg("share").alias("share"), F.stddev_pop("share").alias("spread"))
    score = reports.poster_score(F.col("spread"), F.lit(2.5), F.col("share"))
    return s.groupBy("scene_id").agg(F.max_by("idx", F.struct(score.alias("s"), (-F.col("idx")).alias("o"))).alias("idx"), F.max(score).alias("score"))


@query("rob_constants", None)
def rob_constants(x: Tables) -> DataFrame:
    """Constants of a sweep are columns of its trials, so nothing is patched at run time."""
    t = resolver.trial_table(x.spark)
    draw = lambda v, k: F.lit(v) * F.pow(F.lit(1.3), 2 * F.pmod(F.xxhash64("trial", F.lit(k)), F.lit(1_000_003)) / 1_000_003 - 1)
    return t.select("trial", *[F.when(F.col("trial") == 0, v).otherwise(draw(v, k)).alias(k) for k, v in (("min_answer", 0.12), ("prior_ratio", 0.30), ("tie_absolute", 0.04), ("tie_relative", 0.08), ("world_margin", 0.12))])


@query("rob_report", None)
def rob_report(x: Tables) -> DataFrame:
    return reports.table_lines(resolver.sweep(x.utterances.where("relation_type like 'projective%'"), x.objects, x.rooms), ["baseline", "median", "p10", "p90", "least", "most"], ["median"])


@query("sens_report", None)
def sens_report(x: Tables) -> DataFrame:
    from .q_resolver import sens_summarise

    return reports.table_lines(sens_summarise(x), ["relation_type", "n", "disagreed", "flips_intrinsic", "flips_world"], ["relation_type"])


@query("probe_report", None)
def probe_report(x: Tables) -> DataFrame:
    from .q_bench import probe_summary

    return reports.table_lines(probe_summary(x), ["relation", *E.PAIR_OUTCOMES], ["relation"])


@query("seg_agglomerate", None)
def seg_agglomerate(x: Tables) -> DataFrame:
    return reports.agglomerate(masks.segment(x.points), x.points)


@query("clip_label_proposals", "SELECT p_partkey AS instance, CASE p_partkey % 5 WHEN 0 THEN 'floor' WHEN 1 THEN 'wall' ELSE concat('label', p_partkey % 7) END AS label FROM part")
def clip_label_proposals(x: Tables) -> DataFrame:
    """Structure keeps its geometric label, the rest takes the one of its embedding."""
    k = F.col("p_partkey")
    geometric = x.source("part").where(k % 5 < 2).select(k.alias("instance"), F.when(k % 5 == 0, "floor").otherwise("wall").alias("structure"))
    rows = x.source("part").select(k.alias("instance"), F.concat(F.lit("label"), k % 7).alias("guess"))
    return rows.join(geometric, "instance", "left").select("instance", F.coalesce("structure", "guess").alias("label"))


@query("src_dataset_dispatch", "SELECT 'fixture' AS dataset, scene_id, count(*) AS objects FROM fx_objects GROUP BY scene_id")
def src_dataset_dispatch(x: Tables) -> DataFrame:
    """Readers by name return the same set of tables; here there is one."""
    readers = {"fixture": lambda: x.objects}
    return readers["fixture"]().groupBy("scene_id").agg(F.count("*").alias("objects")).select(F.lit("fixture").alias("dataset"), "scene_id", "objects")


@query("item_text_map", None)
def item_text_map(x: Tables) -> DataFrame:
    return reports.text_map(x.objects)


@query("json_clean", "SELECT scene_id, id, label FROM fx_objects")
def json_clean(x: Tables) -> DataFrame:
    """Nested values to JSON and back through a variant."""
    j = x.objects.select("scene_id", "id", F.parse_json(F.to_json(F.struct("label", F.array("cx", "cy").alias("c")))).alias("v"))
    return j.select("scene_id", "id", F.variant_get("v", "$.label", "string").alias("label"))


@query("cloud_buffer", "SELECT scene_id, least(count(*), 400) AS points FROM fx_points GROUP BY scene_id")
def cloud_buffer(x: Tables) -> DataFrame:
    """At most 400 points of each scene, the same in every run (a sampling operator)."""
    return reports.sampled(x.points, ["scene_id"], ["id", "pt_idx"], 400).groupBy("scene_id").agg(F.count("*").alias("points"))


@query("probe_systems", f"SELECT {N} AS prompts, CAST(0 AS BIGINT) AS unanswered FROM fx_utterances")
def probe_systems(x: Tables) -> DataFrame:
    """Answers filed under the digests of prompts, read back by a probe."""
    p = E.prompts(x.utterances, x.objects)
    probe = probes.FileProbe("filed", p.groupBy("key").agg(F.min("query_id").alias("answer")))
    return probe.answers(p).agg(F.count("*").alias("prompts"), F.count_if(F.col("answer").isNull()).alias("unanswered"))


@query("vlm_run", "SELECT query_id, CASE WHEN query_id % 4 <> 0 THEN query_id END AS answer FROM fx_utterances")
def vlm_run(x: Tables) -> DataFrame:
    """A system that is a function: each prompt is asked once, errors are kept as no answer."""

    def ask(prompt: str) -> str:
        n = int(prompt.rsplit("#", 1)[1])
        if n % 4 == 0:
            raise ValueError("no reply")
        return f'{{"id": {n}}}'

    p = x.utterances.select("query_id", F.concat(F.lit("Which object? #"), "query_id").alias("prompt"))
    return probes.FunctionProbe("echo", ask).answers(p)


@query("parse_llm", "SELECT query_id, target, CASE WHEN query_id % 3 = 0 THEN NULL ELSE relation END AS relation, anchor FROM fx_utterances")
def parse_llm(x: Tables) -> DataFrame:
    """Parses that a model replies with; invented relations are dropped."""
    said = F.concat(F.lit("Here it is: "), F.to_json(F.struct("target", F.when(F.col("query_id") % 3 == 0, "floating over").otherwise(F.col("relation")).alias("relation"), "anchor")))
    return x.utterances.select("query_id", probes.proposed_parse(said).alias("p")).select("query_id", "p.target", "p.relation", "p.anchor")
