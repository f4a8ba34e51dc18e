"""Resolution of whole batches of phrases: candidates, anchors, best anchor of each candidate, ranking and flags.

A phrase here is a row with query_id, scene_id, a target class, a relation and an anchor class. Everything is a join on the
scene followed by arg-max aggregates and windows over the query; no phrase is a loop.
"""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_gap, gmean, overlap_share, prefixed
from ..plans.config import CFG, MAX_ANCHORS, MIN_ANSWER, TIE_ABSOLUTE, TIE_RELATIVE, Config, Constants, settings
from . import frames
from . import relations as R


def scored_pairs(queries: DataFrame, objects: DataFrame, rooms: DataFrame, frame: str = "egocentric") -> DataFrame:
    """Each query's candidates with each of its at most MAX_ANCHORS anchors (largest first), in one frame; value is the relation's score."""
    a = prefixed(objects, "a", ("scene_id",)).withColumnRenamed("a_label", "anchor")
    volume = F.col("a_hx") * F.col("a_hy") * F.col("a_hz")
    by_class = Window.partitionBy("scene_id", "anchor").orderBy(volume.desc(), "a_id")
    anchors = a.withColumn("a_rank", F.row_number().over(by_class)).where(F.col("a_rank") <= MAX_ANCHORS)
    t = prefixed(objects, "t", ("scene_id",)).withColumnRenamed("t_label", "target")
    q = queries.select("query_id", "scene_id", "relation", "relation_type", "target", "anchor", "eye_x", "eye_y")
    rows = q.join(anchors, ["scene_id", "anchor"]).join(rooms.select("scene_id", "forward_margin", "axis_confidence", frames.room_scale().alias("scale")), "scene_id")
    # the viewpoint belongs to the query, so frames are read at each anchor but from one eye
    rows = frames.with_axes(rows, F.col("eye_x"), F.col("eye_y")).where(F.col("kind") == frame).drop("kind")
    return score(rows.join(t, ["scene_id", "target"]))


def score(rows: DataFrame) -> DataFrame:
    """Adds value: the score of the row's own relation; 0 for an object and itself, an enclosing candidate or a missing frame.

    Directions, vertical and other relations are branches, so none computes what it doesn't need and each fits one generated
    method; the filter on the relation reaches the table of queries.
    """
    same = F.col("t_id") == F.col("a_id")
    keep = ["query_id", "scene_id", "relation", "relation_type", "t_id", "a_id", "a_rank", "value"]
    keep += [c for c in rows.columns if c in ("kind", "trial")]

    def branch(part: DataFrame, scores: dict[str, Column]) -> DataFrame:
        value = F.lit(0.0)
        for r, c in scores.items():
            value = F.when(F.col("relation") == r, c).otherwise(value)
        return part.withColumn("value", F.when(same, 0.0).otherwise(value)).select(*keep)

    directed = R.with_frame_spans(rows.where(F.col("relation").isin(*R.DIRECTIONS))).withColumn("back", overlap_share(R.A, R.T))
    directed = R.facing(directed.withColumn("blocked", R.encloses(share=F.col("back")).isNotNull() | F.col("rx").isNull() | same))
    vertical = rows.where(F.col("relation").isin("on", "above", "below", "inside")).withColumns({"share": overlap_share(R.T, R.A), "back": overlap_share(R.A, R.T)})
    rest = rows.where(F.col("relation").isin("near", "next_to", "far_from", *R.COMPARED)).withColumn("gap", F.greatest(F.lit(0.0), box_gap(R.T, R.A)))
    g = F.col("gap")
    parts = [
        directed.withColumn("value", F.when(F.col("blocked"), 0.0).otherwise(R.projective())).select(*keep),
        branch(vertical, {"on": R.on(share=F.col("share")), "above": R.above(share=F.col("share")), "below": R.below(share=F.col("back")), "inside": R.inside()}),
        branch(rest, {"near": R.near(g), "next_to": R.next_to(g), "far_from": R.far_from(g, F.col("scale"))} | {r: R.compared(r) for r in R.COMPARED}),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def best_anchor(scored: DataFrame) -> DataFrame:
    """One row per query and candidate: the anchor with the highest score, of equals the one that ranks first."""
    first = F.struct(F.col("value").alias("value"), (-F.col("a_rank")).alias("order"))
    top = F.max_by(F.struct("a_id", "a_rank", "value"), first).alias("top")
    return scored.groupBy("query_id", "scene_id", "relation", "relation_type", F.col("t_id").alias("target_id")).agg(top).select("query_id", "scene_id", "relation", "relation_type", "target_id", F.col("top.a_id").alias("anchor_id"), F.col("top.value").alias("value"))


def combine(best: DataFrame, label: Column | None = None) -> DataFrame:
    """score = geometric mean of relation terms times label and colour agreement; here of one relation."""
    return best.withColumn("score", gmean([F.greatest(F.col("value"), F.lit(1e-6))], [1.0]) * (F.lit(1.0) if label is None else label))


def ranked(combined: DataFrame) -> DataFrame:
    """Survivors (above 1e-3, unless none is) by rank, with the runner-up's score."""
    w = Window.partitionBy("query_id")
    kept = combined.withColumn("alive", F.max("score").over(w) > 1e-3).where(~F.col("alive") | (F.col("score") > 1e-3))
    order = w.orderBy(F.col("score").desc(), "target_id")
    return kept.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).drop("alive")


def tie(top: Column, second: Column) -> Column:
    return F.coalesce((top > 1e-9) & (top - second <= F.greatest(F.lit(TIE_ABSOLUTE), top * TIE_RELATIVE)), F.lit(False))


def resolve(queries: DataFrame, objects: DataFrame, rooms: DataFrame, frame: str = "egocentric") -> DataFrame:
    """query_id, scene_id, target_id, anchor_id, score, second, score_tie, weak_match: the answer to each query in one frame."""
    top = ranked(combine(best_anchor(scored_pairs(queries, objects, rooms, frame)))).where("rank = 1")
    return top.select("query_id", "scene_id", "relation", "relation_type", "target_id", "anchor_id", "score", "second", tie(F.col("score"), F.col("second")).alias("score_tie"), (F.col("score") < MIN_ANSWER).alias("weak_match"))


def every(queries: DataFrame, objects: DataFrame, rooms: DataFrame, frame: str = "egocentric") -> DataFrame:
    """query_id, scene_id, target_id, anchor_id, score, second, score_tie, weak_match, no_candidate: a row for every query.

    Without the target's class in the scene there is no answer; without the anchor's, all candidates fail alike and the first by id stands, with a
    weak score; both are flagged no_candidate. A query without a relation takes any object of its class. query_id is a key of queries.
    """
    classes = objects.groupBy("scene_id", "label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    t, a = classes.withColumnRenamed("label", "target"), classes.select("scene_id", F.col("label").alias("anchor"), F.col("n").alias("anchors"))
    found = resolve(queries, objects, rooms, frame).select("query_id", F.col("target_id").alias("found"), "anchor_id", F.col("score").alias("found_score"), F.col("second").alias("found_second"))
    rows = queries.select("query_id", "scene_id", "relation", "target", "anchor").join(t, ["scene_id", "target"], "left").join(a, ["scene_id", "anchor"], "left").join(found, "query_id", "left")
    alike = F.when(F.col("relation").isNull(), 1.0).when(F.col("anchors").isNull(), 1e-6)  # the score of all candidates
    rows = rows.select(
        "query_id", "scene_id", F.when(alike.isNull(), F.col("found")).otherwise(F.col("first")).alias("target_id"), "anchor_id",
        F.when(F.col("n").isNotNull(), F.coalesce(alike, "found_score")).alias("score"), F.when(alike.isNull(), F.col("found_second")).when(F.col("n") > 1, alike).alias("second"),
        (F.col("n").isNull() | (F.col("relation").isNotNull() & F.col("anchors").isNull())).alias("no_candidate"),
    )
    known = F.col("score").isNotNull()
    return rows.withColumns({"score_tie": F.coalesce(known & tie(F.col("score"), F.col("second")), F.lit(False)), "weak_match": known & (F.col("score") < MIN_ANSWER)})


#: Frames that are compared with each other.
COMPARED_FRAMES = ("egocentric", "intrinsic", "addressee", "world")


def framed_pairs(queries: DataFrame, objects: DataFrame, rooms: DataFrame, kinds: tuple[str, ...] = COMPARED_FRAMES) -> DataFrame:
    """As scored_pairs, with a row for each kind of frame: frames are exploded at the anchors, before targets are joined."""
    a = prefixed(objects, "a", ("scene_id",)).withColumnRenamed("a_label", "anchor")
    volume = F.col("a_hx") * F.col("a_hy") * F.col("a_hz")
    anchors = a.withColumn("a_rank", F.row_number().over(Window.partitionBy("scene_id", "anchor").orderBy(volume.desc(), "a_id"))).where(F.col("a_rank") <= MAX_ANCHORS)
    q = queries.select("query_id", "scene_id", "relation", "relation_type", "target", "anchor", "eye_x", "eye_y")
    rows = q.join(anchors, ["scene_id", "anchor"]).join(rooms.select("scene_id", "forward_margin", "axis_confidence", frames.room_scale().alias("scale")), "scene_id")
    rows = frames.with_axes(rows, F.col("eye_x"), F.col("eye_y")).where(F.col("kind").isin(*kinds))
    t = prefixed(objects, "t", ("scene_id",)).withColumnRenamed("t_label", "target")
    return score(rows.join(t, ["scene_id", "target"]))


def under_frames(queries: DataFrame, objects: DataFrame, rooms: DataFrame) -> DataFrame:
    """query_id, relation_type, kind, answer, score: the answer of each frame, null below MIN_ANSWER or where none is ahead."""
    scored = framed_pairs(queries, objects, rooms)
    best = scored.groupBy("query_id", "relation_type", "kind", "t_id").agg(F.max("value").alias("value"))
    top = best.groupBy("query_id", "relation_type", "kind").agg(F.max(F.struct("value", (-F.col("t_id")).alias("o"))).alias("top"), F.array_sort(F.collect_list(F.round("value", 9))).alias("values"))
    second = F.get("values", F.size("values") - 2)
    score_ = F.greatest(F.col("top.value"), F.lit(1e-6))
    clear = second.isNull() | (score_ - F.greatest(second, F.lit(1e-6)) > 1e-6)
    return top.select("query_id", "relation_type", "kind", F.when((score_ >= MIN_ANSWER) & clear, -F.col("top.o")).alias("answer"), score_.alias("score"))


def answers(queries: DataFrame, objects: DataFrame, rooms: DataFrame) -> DataFrame:
    """under_frames for direction phrases, one row per query and a column for each frame."""
    rows = under_frames(queries.where(F.col("relation_type").startswith("projective")), objects, rooms)
    return rows.groupBy("query_id", "relation_type").pivot("kind", list(COMPARED_FRAMES)).agg(F.first("answer"))


def trial_table(spark, trials: int = 20, scale: float = 0.3, seed: int = 0) -> DataFrame:
    """trial, full, half, slack: jittered cones and depths; trial 0 has the defaults."""
    return spark.createDataFrame(_trials(trials, scale, seed), "trial int, full double, half double, slack double")


def _trials(trials: int, scale: float, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    draw = lambda v: v * (1 + scale) ** rng.uniform(-1, 1)
    rows = [(0, CFG.cone_full_credit_deg, CFG.cone_half_angle_deg, CFG.depth_overlap_slack)]
    for i in range(1, trials + 1):
        full, half = sorted((draw(CFG.cone_full_credit_deg), draw(CFG.cone_half_angle_deg)))
        rows.append((i, full, half, draw(CFG.depth_overlap_slack)))
    return rows


def sweep(queries: DataFrame, objects: DataFrame, rooms: DataFrame, trials: int = 20, scale: float = 0.3, seed: int = 0) -> DataFrame:
    """Rate of disagreement between egocentric and intrinsic answers while every threshold and constant is jittered: median, 10th and 90th percentile,
    extremes, and the same in by_type for each relation_type.

    Trials are rows that are crossed with the scored pairs' measures, not runs: geometry is computed once for all of them, and once for phrases that
    ask the same from the same eye. Only pairs that are the best of their phrase and frame in some trial are crossed, and none of phrases that all trials
    answer alike. query_id is a key of queries. All thresholds and constants are drawn; those of other relations, of flags, labels and the choice of a
    frame can't change what a direction means in a given frame.
    """
    rows = settings(trials, scale, seed)
    answer = F.coalesce(F.min("answer") < F.max("answer"), F.lit(False)).alias("split")
    split = _answers(queries, objects, rooms, rows, enclosing=True).groupBy("question", "trial").agg(F.first("relation_type").alias("relation_type"), F.first("asked").alias("asked"), answer)
    found = split.groupBy("relation_type", "trial").agg(F.sum(F.when(F.col("split"), F.col("asked")).otherwise(0)).alias("n"))
    n = _spread(found, rows).groupBy(F.col("relation_type").alias("type"), F.col("trial").alias("of")).agg(F.sum("n").alias("n"))
    # a trial without any answer has a rate of 0
    every = queries.groupBy("relation_type").agg(F.count("*").alias("all")).withColumn("trial", F.explode(F.array(*[F.lit(r[0]) for r in rows])))
    cells = every.join(n, F.col("relation_type").eqNullSafe(F.col("type")) & (F.col("trial") == F.col("of")), "left")
    rates = cells.rollup("trial", "relation_type").agg((F.sum(F.coalesce("n", F.lit(0))) / F.sum("all")).alias("rate"), F.grouping_id().alias("level")).where("level < 2")
    jittered = F.when(F.col("trial") > 0, F.col("rate"))
    names = {
        "baseline": F.max(F.when(F.col("trial") == 0, F.col("rate"))), "median": F.percentile(jittered, 0.5), "p10": F.percentile(jittered, 0.1), "p90": F.percentile(jittered, 0.9), "least": F.min(jittered), "most": F.max(jittered),
    }
    spread = rates.groupBy("level", "relation_type").agg(*[c.alias(k) for k, c in names.items()])
    overall = F.col("level") == 1
    return spread.agg(*[F.max(F.when(overall, F.col(k))).alias(k) for k in names], F.sort_array(F.collect_list(F.when(~overall, F.struct("relation_type", *names)))).alias("by_type"))


#: Slack of bounds, well above what rounding adds to a score and below any difference that counts.
_ROUNDING = 1e-9


def trial_answers(queries: DataFrame, objects: DataFrame, rooms: DataFrame, rows: list[tuple], enclosing: bool = False) -> DataFrame:
    """question (the smallest query_id that asks it), asked (how many do), kind, trial, answer: of direction phrases in two frames, for each of the
    trials, (trial, thresholds, constants) or (trial, full, half, slack); answer is null, or the row missing, where nothing reaches the least score.
    enclosing: whether targets that support or contain the anchor are ruled out, as score() does and the sweep asks."""
    return _spread(_answers(queries, objects, rooms, rows, enclosing), rows).select("question", "asked", "kind", "trial", "answer")


def _spread(found: DataFrame, rows: list[tuple]) -> DataFrame:
    """Rows without a trial, which hold in all of them, once for each."""
    return found.withColumn("trial", F.explode(F.when(F.col("trial").isNull(), F.array(*[F.lit(r[0]) for r in rows])).otherwise(F.array("trial"))))


def _full(row: tuple) -> tuple[int, Config, Constants]:
    """A trial with all thresholds and constants; (trial, full, half, slack) has the defaults of all others."""
    if len(row) == 3:
        return row
    trial, full, half, slack = row
    return trial, replace(CFG, cone_full_credit_deg=full, cone_half_angle_deg=half, depth_overlap_slack=slack), Constants()


#: Thresholds with which a direction's value rises, those with which it falls, and the weights of its terms.
_RISING = ("cone_full_credit_deg", "cone_half_angle_deg", "depth_overlap_slack", "height_band", "height_band_hard", "proximity_floor", "proximity_full_factor", "proximity_zero_factor", "proximity_cutoff_factor")
_FALLING = ("lateral_separation_zero", "lateral_separation_full")
_WEIGHTS = {"cone": "w_cone", "separation": "w_separation", "depth": "w_depth", "height": "w_height", "preference": "w_proximity"}


def _answers(queries: DataFrame, objects: DataFrame, rooms: DataFrame, rows: list[tuple], enclosing: bool = False) -> DataFrame:
    """As trial_answers, with relation_type; a question whose answers are the same in all trials by their bounds has no trial, and a row for each frame."""
    rows = [_full(r) for r in rows]
    of = lambda k: [getattr(c, k) for _, c, _ in rows]
    answers = [x.min_answer for _, _, x in rows]
    shares = {w: [v / t for v, t in zip(of(w), map(sum, zip(*map(of, _WEIGHTS.values()))))] for w in _WEIGHTS.values()}
    a = prefixed(objects, "a", ("scene_id",)).withColumnRenamed("a_label", "anchor")
    volume = F.col("a_hx") * F.col("a_hy") * F.col("a_hz")
    anchors = a.withColumn("a_rank", F.row_number().over(Window.partitionBy("scene_id", "anchor").orderBy(volume.desc(), "a_id"))).where(F.col("a_rank") <= MAX_ANCHORS)
    questions = queries.groupBy("scene_id", "relation", "relation_type", "target", "anchor", "eye_x", "eye_y").agg(F.min("query_id").alias("question"), F.count("*").alias("asked"))
    q = questions.join(anchors, ["scene_id", "anchor"]).join(rooms.select("scene_id", "forward_margin", "axis_confidence"), "scene_id")
    f = frames.with_axes(q, F.col("eye_x"), F.col("eye_y")).where(F.col("kind").isin("egocentric", "intrinsic") & F.col("available"))
    # few rows become many pairs here: all tasks that there are get a share (a shuffle without a number would be coalesced by the bytes of the few), and
    # what stands before and behind isn't one generated method, which would be too long where all joins are broadcast
    f = f.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "question")
    t = prefixed(objects, "t", ("scene_id",)).withColumnRenamed("t_label", "target")
    pairs = R.facing(R.with_frame_spans(f.join(t, ["scene_id", "target"]).where("t_id <> a_id")))
    if 1e-6 ** min(shares["w_cone"]) < min(answers):  # beyond the widest cone no trial lifts a pair to its least score
        pairs = pairs.where(F.degrees(F.atan2(F.abs(F.col("ac")), F.col("al"))) < max(of("cone_half_angle_deg")))
    # generated, so that the filters below read the measures and don't repeat their expressions, which no generated method would hold
    keep = ["question", "asked", "relation_type", "kind", "t_id"]
    flat = pairs.select(*keep, F.explode(F.array(F.struct(*[v.alias(k) for k, v in R.measures().items()]))).alias("of")).select(*keep, "of.*").withColumn("held", R.held() if enclosing else F.lit(-1.0)).drop("share", "rests", "within")

    # a value rises or falls with each threshold, and with a weight's share by its term, so it lies between those of the extremes of all trials; a pair
    # whose highest value is below another's lowest is the best in no trial
    def bound(rise, fall) -> Column:
        v = R.measured_terms(Config(**{k: rise(of(k)) for k in _RISING}, **{k: fall(of(k)) for k in _FALLING}))
        weights = [fall(shares[w]) for w in _WEIGHTS.values()]
        return F.pow(gmean([v[k] for k in _WEIGHTS], weights), F.lit(sum(weights))) * v["locality"]

    low, high = bound(min, max), bound(max, min)
    free = F.col("held") < min(of("support_min_overlap"))  # in no trial does the target enclose the anchor
    bounds = flat.where(F.col("held") < max(of("support_min_overlap"))).select("*", F.explode(F.array(F.struct(F.when(free, low).otherwise(0.0).alias("low"), high.alias("high")))).alias("bound")).select("*", "bound.*").drop("bound")
    bounds = bounds.where(F.col("high") >= min(answers) - _ROUNDING)
    # windows and aggregates go by the question, so pairs are shuffled once, or stay where they are if the join with targets is broadcast
    w = Window.partitionBy("question")
    ego = F.col("kind") == "egocentric"
    best = F.when(ego, F.max(F.when(ego, F.col("low"))).over(w)).otherwise(F.max(F.when(~ego, F.col("low"))).over(w))
    rivals = bounds.withColumn("beaten", best).where(F.col("high") >= F.col("beaten") - _ROUNDING)
    # with one rival a frame, and none that can fall below the least score, all trials have the same answers
    alone = F.greatest(F.count_if(ego).over(w), F.count_if(~ego).over(w)) == 1
    rivals = rivals.withColumn("settled", alone & (F.min("low").over(w) >= max(answers) + _ROUNDING)).drop("low", "high", "beaten")
    names = (*_RISING, *_FALLING, *_WEIGHTS.values(), "support_min_overlap")
    trial = lambda i, c, x: F.struct(F.lit(i).cast("int").alias("trial"), F.lit(float(x.min_answer)).alias("min_answer"), *[F.lit(float(getattr(c, k))).alias(k) for k in names])
    tried = rivals.withColumn("of", F.explode(F.when(F.col("settled"), F.array(trial(None, *rows[0][1:]))).otherwise(F.array(*[trial(*r) for r in rows])))).select("*", "of.*")
    v = R.measured_terms(Config(**{k: F.col(k) for k in names}))
    value = F.when(F.col("held") < F.col("support_min_overlap"), gmean([v[k] for k in _WEIGHTS], [F.col(w) for w in _WEIGHTS.values()]) * v["locality"]).otherwise(0.0)
    top = tried.groupBy("question", "kind", "trial").agg(*[F.first(k).alias(k) for k in ("asked", "relation_type", "min_answer")], F.max(F.struct(value.alias("v"), (-F.col("t_id")).alias("o"))).alias("top"))
    return top.select("question", "asked", "relation_type", "kind", "trial", F.when(F.col("top.v") >= F.col("min_answer"), -F.col("top.o")).alias("answer"))
