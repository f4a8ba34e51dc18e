"""Queries of benchmark items, proposals, evaluation, probes, masks, fronts and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, clip, prefixed, r9, ramp
from ..operators import evaluation as E
from ..operators import fronts, masks, proposals
from . import oracle as O
from .catalog import query
from .fixtures import Tables
from .q_geometry import _KIND_SQL

N = "CAST(count(*) AS BIGINT)"


def n_if(condition: str) -> str:
    return f"CAST(count_if({condition}) AS BIGINT)"


# evaluation -----------------------------------------------------------------------------------------------------------------------

# prediction and gold of 0 stand for none; the annotated kind follows from the difficulty
_OUT = "o AS (SELECT *, nullif(predicted_id, 0) AS pred, nullif(gold_id, 0) AS gold, CASE WHEN ambiguous_gold AND gold_id = 0 THEN flagged_ambiguous WHEN predicted_id = 0 THEN gold_id = 0 ELSE predicted_id = gold_id END AS correct FROM fx_outcomes)"
_DEP = "relation_type IN ('projective_lateral', 'projective_frontal', 'ordinal')"


def outcomes(x: Tables) -> DataFrame:
    none = lambda c: F.when(F.col(c) != 0, F.col(c))
    rows = x.outcomes.withColumns({"pred": none("predicted_id"), "gold": none("gold_id")})
    return rows.withColumn("correct", E.correct(F.col("pred"), F.array_compact(F.array("gold")), F.col("ambiguous_gold"), F.col("flagged_ambiguous")))


@query("eval_correct", f"WITH {_OUT} SELECT condition_key, correct, {N} AS n FROM o GROUP BY condition_key, correct")
def eval_correct(x: Tables) -> DataFrame:
    """An ambiguous item without an acceptable answer is right if it is flagged; no prediction is right if there is no gold."""
    return outcomes(x).groupBy("condition_key", "correct").agg(F.count("*").alias("n"))


_PR = "p AS (SELECT condition_key, {tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn FROM o GROUP BY condition_key)".format(tp=n_if("ambiguous_gold AND flagged_ambiguous"), fp=n_if("NOT ambiguous_gold AND flagged_ambiguous"), fn=n_if("ambiguous_gold AND NOT flagged_ambiguous"), tn=n_if("NOT ambiguous_gold AND NOT flagged_ambiguous"))


@query("eval_binary", f"WITH {_OUT}, {_PR} SELECT condition_key, tp, fp, fn, tn, {O.r9('CAST(tp AS DOUBLE) / nullif(tp + fp, 0)')} AS precision, {O.r9('CAST(tp AS DOUBLE) / nullif(tp + fn, 0)')} AS recall, {O.r9('2.0E0 * tp / nullif(CASE WHEN tp > 0 THEN 2 * tp + fp + fn END, 0)')} AS f1 FROM p")
def eval_binary(x: Tables) -> DataFrame:
    """Detection of ambiguity; F1 is null, not 0, where precision or recall is 0 or undefined."""
    return E.binary(outcomes(x).groupBy("condition_key"), F.col("ambiguous_gold"), F.col("flagged_ambiguous"))


@query("eval_aggregate", f"WITH {_OUT} SELECT relation_type, gold_frame, difficulty, scene_id, {N} AS n, {O.r9('avg(CAST(correct AS INT))')} AS accuracy, median(elapsed_ms) AS median_ms FROM o GROUP BY GROUPING SETS ((), (relation_type), (gold_frame), (difficulty), (scene_id))")
def eval_aggregate(x: Tables) -> DataFrame:
    """Overall and by each of four groupings in one pass of grouping sets."""
    return E.accuracy_cube(outcomes(x))


@query("eval_slices", f"WITH {_OUT} SELECT condition_key, {O.r9('avg(CASE WHEN NOT ambiguous_gold THEN CAST(correct AS INT) END)')} AS unambiguous, {O.r9('avg(CASE WHEN ambiguous_gold THEN CAST(correct AS INT) END)')} AS ambiguous, {O.r9(f'avg(CASE WHEN {_DEP} THEN CAST(correct AS INT) END)')} AS frame_dependent, {O.r9(f'avg(CASE WHEN NOT ({_DEP}) THEN CAST(correct AS INT) END)')} AS frame_independent FROM o GROUP BY condition_key")
def eval_slices(x: Tables) -> DataFrame:
    dep = F.col("relation_type").isin("projective_lateral", "projective_frontal", "ordinal")
    part = lambda c: r9(F.avg(F.when(c, F.col("correct").cast("int"))))
    return outcomes(x).groupBy("condition_key").agg(part(~F.col("ambiguous_gold")).alias("unambiguous"), part(F.col("ambiguous_gold")).alias("ambiguous"), part(dep).alias("frame_dependent"), part(~dep).alias("frame_independent"))


_COND = f"{_OUT}, i AS (SELECT item_key, condition_key, bool_or(correct) AS correct, bool_or(ambiguous_gold) AS amb, bool_and(pred IS NULL) AS none, min(relation_type) AS relation_type FROM o GROUP BY item_key, condition_key)"


@query("eval_condition", f"WITH {_COND} SELECT condition_key, relation_type, {N} AS items, {n_if('correct')} AS right_items FROM i GROUP BY condition_key, relation_type")
def eval_condition(x: Tables) -> DataFrame:
    return E.by_item(outcomes(x)).groupBy("condition_key", "relation_type").agg(F.count("*").alias("items"), F.count_if("correct").alias("right_items"))


@query(
    "eval_attribution",
    f"WITH {_COND}, b AS (SELECT n.*, coalesce(a.correct, FALSE) AS parse_ok, coalesce(r.correct, FALSE) AS frame_ok FROM (SELECT * FROM i WHERE condition_key = 'N' AND NOT correct) n LEFT JOIN (SELECT * FROM i WHERE condition_key = 'A') a ON a.item_key = n.item_key LEFT JOIN (SELECT * FROM i WHERE condition_key = 'R') r ON r.item_key = n.item_key), "
    f"c AS (SELECT relation_type, CASE WHEN amb THEN 'ambiguous_item' WHEN none THEN 'unresolvable' WHEN parse_ok THEN 'parse' WHEN frame_ok THEN 'frame_convention' ELSE 'geometry' END AS cause FROM b) SELECT relation_type, cause, {N} AS n FROM c GROUP BY relation_type, cause",
)
def eval_attribution(x: Tables) -> DataFrame:
    """Each failure of a baseline goes to the first condition that repairs it: conditions are joined by item, not replayed."""
    return E.attribution(E.by_item(outcomes(x)), baseline="N", gold_parse="A", oracle_frame="R").groupBy("relation_type", "cause").agg(F.count("*").alias("n"))


@query("eval_frame_available", f"SELECT o.gold_frame, {N} AS n, {n_if('o.gold_frame <> ' + chr(39) + 'intrinsic' + chr(39) + ' OR b.front_x IS NOT NULL')} AS available FROM fx_outcomes o LEFT JOIN fx_objects b ON b.scene_id = o.scene_id AND b.id = o.gold_id GROUP BY o.gold_frame")
def eval_frame_available(x: Tables) -> DataFrame:
    o = x.outcomes.join(x.objects.select("scene_id", F.col("id").alias("gold_id"), "front_x"), ["scene_id", "gold_id"], "left")
    return o.groupBy("gold_frame").agg(F.count("*").alias("n"), F.count_if((F.col("gold_frame") != "intrinsic") | F.col("front_x").isNotNull()).alias("available"))


@query("eval_report", None)
def eval_report(x: Tables) -> DataFrame:
    """The accuracy table as lines of markdown."""
    rows = outcomes(x).groupBy("condition_key", "relation_type").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("a"))
    return rows.orderBy("condition_key", "relation_type").select(F.format_string("| %s | %s | %d | %.1f%% |", "condition_key", "relation_type", "n", F.col("a") * 100).alias("line"))


@query("labels_binary", f"SELECT {n_if('quality = 1 AND toxic = 1')} AS tp, {n_if('quality <> 1 AND toxic = 1')} AS fp, {n_if('quality = 1 AND toxic <> 1')} AS fn, {n_if('quality <> 1 AND toxic <> 1')} AS tn FROM labels")
def labels_binary(x: Tables) -> DataFrame:
    g, p = F.col("quality") == 1, F.col("toxic") == 1
    return x.source("labels").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


# items ----------------------------------------------------------------------------------------------------------------------------

_ITEMS = "it AS (SELECT query_id, scene_id, relation_type, CASE WHEN query_id % 11 = 0 THEN '' ELSE concat('q', query_id) END AS id, CASE WHEN query_id % 13 = 0 THEN ' ' ELSE text END AS text, CASE WHEN query_id % 7 = 0 THEN 'bogus' ELSE 'egocentric' END AS frame, query_id % 5 = 0 AS ambiguous, CASE WHEN query_id % 10 = 0 THEN 'none' ELSE 'anchor' END AS ambiguity_kind, query_id % 3 AS n_targets, CASE WHEN query_id % 17 = 0 THEN 'extreme' WHEN query_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty, CASE query_id % 4 WHEN 0 THEN 'position' ELSE 'best_view' END AS viewpoint_mode FROM fx_utterances)"


def items(x: Tables) -> DataFrame:
    return proposals.sample_items(x.utterances)


_PROBLEMS = ["id = ''", "trim(text) = ''", "frame NOT IN ('egocentric', 'intrinsic', 'addressee', 'world', 'any')", "ambiguous AND ambiguity_kind = 'none'", "NOT ambiguous AND n_targets <> 1", "difficulty NOT IN ('easy', 'medium', 'hard')", "viewpoint_mode = 'position'"]


@query("item_validate", f"WITH {_ITEMS} SELECT query_id, CAST({' + '.join(f'CASE WHEN {p} THEN 1 ELSE 0 END' for p in _PROBLEMS)} AS INT) AS problems FROM it")
def item_validate(x: Tables) -> DataFrame:
    """All rules at once as an array of problems."""
    return items(x).select("query_id", F.size(proposals.problems()).alias("problems"))


@query("item_split", f"WITH {_ITEMS} SELECT relation_type, difficulty, {N} AS n, {n_if('ambiguous')} AS ambiguous FROM it GROUP BY GROUPING SETS ((), (relation_type), (difficulty))")
def item_split(x: Tables) -> DataFrame:
    return items(x).groupingSets([[], [F.col("relation_type")], [F.col("difficulty")]], "relation_type", "difficulty").agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("ambiguous"))


@query("item_order_queue", f"WITH {_ITEMS} SELECT query_id, row_number() OVER (PARTITION BY scene_id ORDER BY CASE WHEN relation_type LIKE 'projective%' THEN 0 ELSE 1 END, CASE difficulty WHEN 'hard' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, query_id) AS place FROM it")
def item_order_queue(x: Tables) -> DataFrame:
    """Each scene's annotation queue: most informative first."""
    rank = F.when(F.col("relation_type").startswith("projective"), 0).otherwise(1)
    hard = F.when(F.col("difficulty") == "hard", 0).when(F.col("difficulty") == "medium", 1).otherwise(2)
    w = Window.partitionBy("scene_id").orderBy(rank, hard, "query_id")
    return items(x).select("query_id", F.row_number().over(w).cast("long").alias("place"))


_MENTION = "(o.label = u.target OR o.label = u.anchor)"


@query("item_relevant_ids", f"SELECT u.query_id, {N} AS objects, CAST(min(o.id) AS BIGINT) AS first_id FROM fx_utterances u JOIN fx_objects o ON o.scene_id = u.scene_id AND contains(concat(' ', u.text, ' '), concat(' ', o.label, ' ')) GROUP BY u.query_id")
def item_relevant_ids(x: Tables) -> DataFrame:
    """Objects whose class a text mentions: its words are exploded and joined by class, so the join is equi."""
    return proposals.mentioned(x.utterances, x.objects).groupBy("query_id").agg(F.count("*").alias("objects"), F.min("id").alias("first_id"))


@query("item_anchor_target_split", f"SELECT u.query_id, {n_if('o.label = u.target')} AS targets, {n_if('o.label = u.anchor')} AS anchors FROM fx_utterances u JOIN fx_objects o ON o.scene_id = u.scene_id AND {_MENTION} GROUP BY u.query_id")
def item_anchor_target_split(x: Tables) -> DataFrame:
    m = proposals.mentioned(x.utterances, x.objects).join(x.utterances.select("query_id", "target", "anchor"), "query_id")
    return m.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("target")).alias("targets"), F.count_if(F.col("label") == F.col("anchor")).alias("anchors"))


@query("item_blind_payload", "SELECT query_id, scene_id, text FROM fx_utterances")
def item_blind_payload(x: Tables) -> DataFrame:
    """What an annotator may see: a list of allowed columns, none of them a prediction."""
    return x.utterances.select(*proposals.BLIND)


@query("item_view", f"SELECT u.query_id, o.id, row_number() OVER (PARTITION BY u.query_id ORDER BY round((o.cx - u.eye_x) * (c.my - u.eye_y) - (o.cy - u.eye_y) * (c.mx - u.eye_x), 9), o.id) AS badge FROM fx_utterances u JOIN fx_objects o ON o.scene_id = u.scene_id AND o.label = u.target JOIN (SELECT scene_id, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM fx_rooms) c ON c.scene_id = u.scene_id")
def item_view(x: Tables) -> DataFrame:
    """Badges of candidates from left to right as the viewer sees them."""
    c = x.rooms.select("scene_id", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    rows = x.utterances.join(x.objects.withColumnRenamed("label", "target"), ["scene_id", "target"]).join(c, "scene_id")
    side = (F.col("cx") - F.col("eye_x")) * (F.col("my") - F.col("eye_y")) - (F.col("cy") - F.col("eye_y")) * (F.col("mx") - F.col("eye_x"))
    return rows.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(side, 9), "id")).cast("long").alias("badge"))


@query("item_annotate_save", "SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS latest, count(*) AS saves FROM events GROUP BY user_id")
def item_annotate_save(x: Tables) -> DataFrame:
    """An append-only log of annotations, of which the latest counts."""
    return x.source("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.count("*").alias("saves"))


# proposals ------------------------------------------------------------------------------------------------------------------------

_USE = "u AS (SELECT *, 2 * sqrt(hx * hx + hy * hy + hz * hz) AS diameter, 8 * hx * hy * hz AS volume FROM fx_objects WHERE 2 * sqrt(hx * hx + hy * hy + hz * hz) >= 0.05E0)"


@query("gen_usable", f"WITH {_USE} SELECT scene_id, id, {O.r9('diameter')} AS diameter FROM u")
def gen_usable(x: Tables) -> DataFrame:
    return proposals.usable(x.objects).select("scene_id", "id", r9(F.col("diameter")).alias("diameter"))


@query("gen_classes", f"WITH {_USE} SELECT scene_id, label, {N} AS n, min(id) AS first_id FROM u GROUP BY scene_id, label")
def gen_classes(x: Tables) -> DataFrame:
    return proposals.usable(x.objects).groupBy("scene_id", "label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_SAL = f"{_USE}, s AS (SELECT scene_id, label, 1.0E0 * (0.45E0 + 0.35E0 * least(1.0E0, ln(1 + 20 * median(volume)) / 3) + 0.2E0 / (1 + 0.25E0 * (count(*) - 1))) + CASE WHEN bool_or(front_x IS NOT NULL) THEN 0.3E0 ELSE 0.0E0 END AS salience FROM u GROUP BY scene_id, label)"


@query("gen_anchor_salience", f"WITH {_SAL} SELECT scene_id, label, {O.r9('salience')} AS salience FROM s")
def gen_anchor_salience(x: Tables) -> DataFrame:
    return proposals.salience(x.objects).select("scene_id", "label", r9(F.col("salience")).alias("salience"))


@query("gen_anchor_topk", f"WITH {_SAL} SELECT scene_id, label, row_number() OVER (PARTITION BY scene_id ORDER BY round(salience, 9) DESC, label) AS place FROM s QUALIFY place <= 12")
def gen_anchor_topk(x: Tables) -> DataFrame:
    w = Window.partitionBy("scene_id").orderBy(F.round("salience", 9).desc(), "label")
    return proposals.salience(x.objects).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 12").select("scene_id", "label", "place")


def _generated() -> str:
    """Best score of each class pair under each frame, for left; ends in g(scene_id, target, anchor, kind, best)."""
    parts = []
    for k in ("egocentric", "intrinsic", "addressee", "world"):
        rx, ry, fx, fy, _, ok = _KIND_SQL[k]
        col = lambda e: e.replace("front_", "a.front_").replace("lx", "a.lx").replace("ly", "a.ly")
        inner = O.framed(col(rx), col(ry), col(fx), col(fy), O.EGO, ok.replace("front_x", "a.front_x") + " AND t.label <> a.label").replace("SELECT t.scene_id,", "SELECT t.label AS target, a.label AS anchor, t.scene_id,", 1)
        parts.append(f"SELECT scene_id, target, anchor, '{k}' AS kind, max({O.projective_value('left')}) AS best FROM ({inner}) p GROUP BY scene_id, target, anchor")
    return f"g AS ({' UNION ALL '.join(parts)})"


@query("gen_frame_answers", f"WITH {_generated()} SELECT scene_id, target, anchor, kind, {O.r9('CASE WHEN best >= 0.12E0 THEN best END')} AS best FROM g")
def gen_frame_answers(x: Tables) -> DataFrame:
    """The best pair of each two classes to the left, under each frame."""
    g = proposals.class_pairs(x.objects, x.rooms, "left")
    return g.select("scene_id", "target", "anchor", "kind", r9(F.when(F.col("best") >= 0.12, F.col("best"))).alias("best"))


@query("gen_difficulty", f"WITH {_generated()}, d AS (SELECT scene_id, target, anchor, {n_if('best >= 0.12E0')} AS frames FROM g GROUP BY scene_id, target, anchor), c AS (SELECT scene_id, label, count(*) AS n FROM fx_objects GROUP BY scene_id, label) SELECT d.scene_id, target, anchor, frames, CASE WHEN frames > 1 OR c.n > 2 THEN 'medium' ELSE 'easy' END AS difficulty FROM d JOIN c ON c.scene_id = d.scene_id AND c.label = d.anchor WHERE frames > 0")
def gen_difficulty(x: Tables) -> DataFrame:
    g = proposals.class_pairs(x.objects, x.rooms, "left").groupBy("scene_id", "target", "anchor").agg(F.count_if(F.col("best") >= 0.12).alias("frames")).where("frames > 0")
    c = x.objects.groupBy("scene_id", F.col("label").alias("anchor")).agg(F.count("*").alias("n"))
    return g.join(c, ["scene_id", "anchor"]).select("scene_id", "target", "anchor", "frames", F.when((F.col("frames") > 1) | (F.col("n") > 2), "medium").otherwise("easy").alias("difficulty"))


@query("gen_pairs", f"SELECT scene_id, target_id, anchor_id, {O.r9('v')} AS score FROM (SELECT t.scene_id, t.id AS target_id, a.id AS anchor_id, 1.0E0 - {O.ramp('greatest(0.0E0, ' + O.box_gap('t', 'a') + ')', '0.3E0 + 0.3E0 * (' + O.reach('t') + ' + ' + O.reach('a') + ')', '3 * (0.3E0 + 0.3E0 * (' + O.reach('t') + ' + ' + O.reach('a') + '))')} AS v {O.PAIRS}) p WHERE v >= 0.55E0")
def gen_pairs(x: Tables) -> DataFrame:
    """Pairs that are near with 0.55 or more."""
    from .q_relations import ids, pairs
    from ..functions.geometry import box_gap
    from ..operators import relations as R

    rows = pairs(x).withColumn("gap", F.greatest(F.lit(0.0), box_gap(R.T, R.A))).withColumn("score", R.near(F.col("gap")))
    return rows.where("score >= 0.55").select(*ids(), r9(F.col("score")).alias("score"))


@query("gen_projective", None)
def gen_projective(x: Tables) -> DataFrame:
    """Proposals for each direction: class pairs with an object pair within 3.5 m, those on which frames disagree first, 25 a relation and scene."""
    return proposals.propose_directions(x.objects, x.rooms)


@query("gen_ordinals", f"SELECT scene_id, concat('the ', w.word, ' ', label, ' from the ', d.side) AS text, {N} AS n FROM fx_objects CROSS JOIN (VALUES ('first', 1), ('second', 2), ('third', 3)) AS w(word, k) CROSS JOIN (VALUES ('left'), ('right')) AS d(side) GROUP BY scene_id, label, w.word, d.side HAVING count(*) >= 3")
def gen_ordinals(x: Tables) -> DataFrame:
    return proposals.propose_ordinals(x.objects)


@query("gen_controls", "SELECT scene_id, concat('the ', w.word, ' ', label) AS text, arg_max(id, w.s * (CASE w.m WHEN 'height' THEN hz ELSE hx * hy * hz END) * 1000000 - id / 1000000.0E0) AS answer FROM fx_objects CROSS JOIN (VALUES ('tallest', 'height', 1), ('biggest', 'volume', 1), ('smallest', 'volume', -1)) AS w(word, m, s) GROUP BY scene_id, label, w.word HAVING count(*) >= 2")
def gen_controls(x: Tables) -> DataFrame:
    """Phrases whose answer no frame changes."""
    return proposals.propose_superlatives(x.objects)


@query("gen_scene", "WITH p AS (SELECT scene_id, text, query_id AS seq FROM fx_utterances UNION ALL SELECT scene_id, text, 100000000 + query_id FROM fx_utterances_rich) SELECT scene_id, text, min(seq) AS seq FROM p GROUP BY scene_id, text")
def gen_scene(x: Tables) -> DataFrame:
    """All proposals of a scene, of equal texts the first."""
    both = x.utterances.select("scene_id", "text", F.col("query_id").alias("seq")).unionByName(x.rich.select("scene_id", "text", (F.col("query_id") + 100000000).alias("seq")))
    return both.groupBy("scene_id", "text").agg(F.min("seq").alias("seq"))


@query("gen_items", "SELECT scene_id, text, concat('s', scene_id, '_', lpad(CAST(row_number() OVER (PARTITION BY scene_id ORDER BY seq) - 1 AS VARCHAR), 4, '0')) AS id FROM (SELECT scene_id, text, min(query_id) AS seq FROM fx_utterances GROUP BY scene_id, text) p")
def gen_items(x: Tables) -> DataFrame:
    p = x.utterances.groupBy("scene_id", "text").agg(F.min("query_id").alias("seq"))
    n = F.row_number().over(Window.partitionBy("scene_id").orderBy("seq")) - 1
    return p.select("scene_id", "text", F.concat(F.lit("s"), F.col("scene_id"), F.lit("_"), F.lpad(n.cast("string"), 4, "0")).alias("id"))


# minimal pairs and probes ---------------------------------------------------------------------------------------------------------

_PAIR = "pr AS (SELECT query_id, CASE WHEN query_id % 7 = 0 THEN NULL ELSE query_id % 3 END AS given_a, query_id % 4 AS given_b, query_id % 3 AS gold_a, (query_id + 1) % 4 AS gold_b, query_id % 5 AS neutral, relation FROM fx_utterances WHERE relation_type LIKE 'projective%')"
_CLASS = "CASE WHEN given_a IS NULL OR given_b IS NULL THEN 'no_answer' WHEN given_a = given_b THEN 'frame_blind' WHEN given_a = gold_a AND given_b = gold_b THEN 'switched_correctly' WHEN given_a <> gold_a AND given_b <> gold_b THEN 'switched_incorrectly' ELSE 'partial' END"


def probe_pairs(x: Tables) -> DataFrame:
    q = F.col("query_id")
    rows = x.utterances.where(F.col("relation_type").startswith("projective"))
    return rows.select("query_id", F.when(q % 7 != 0, q % 3).alias("given_a"), (q % 4).alias("given_b"), (q % 3).alias("gold_a"), ((q + 1) % 4).alias("gold_b"), (q % 5).alias("neutral"), "relation")


@query("probe_classify", f"WITH {_PAIR} SELECT query_id, {_CLASS} AS outcome FROM pr")
def probe_classify(x: Tables) -> DataFrame:
    """Whether a system switched its answer with the frame of a minimal pair."""
    return probe_pairs(x).select("query_id", E.pair_outcome(["given_a", "given_b"], ["gold_a", "gold_b"]).alias("outcome"))


@query("probe_summary", f"WITH {_PAIR} SELECT relation, {', '.join(f'{n_if(_CLASS + f""" = '{k}'""")} AS {k}' for k in ('no_answer', 'frame_blind', 'switched_correctly', 'switched_incorrectly', 'partial'))} FROM pr GROUP BY relation")
def probe_summary(x: Tables) -> DataFrame:
    rows = probe_pairs(x).withColumn("outcome", E.pair_outcome(["given_a", "given_b"], ["gold_a", "gold_b"]))
    return rows.groupBy("relation").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in E.PAIR_OUTCOMES])


@query("probe_run", f"WITH {_PAIR} SELECT query_id, CASE WHEN neutral = gold_a AND neutral = gold_b THEN 'several' WHEN neutral = gold_a THEN 'a' WHEN neutral = gold_b THEN 'b' ELSE 'neither' END AS implied FROM pr")
def probe_run(x: Tables) -> DataFrame:
    n, a, b = F.col("neutral"), F.col("gold_a"), F.col("gold_b")
    return probe_pairs(x).select("query_id", F.when((n == a) & (n == b), "several").when(n == a, "a").when(n == b, "b").otherwise("neither").alias("implied"))


@query("probe_controls", f"WITH {_PAIR} SELECT {N} AS n, {n_if('given_a IS NOT DISTINCT FROM given_b')} AS stable, {n_if('given_a = gold_a AND given_b = gold_a')} AS right_both FROM pr")
def probe_controls(x: Tables) -> DataFrame:
    a, b, g = F.col("given_a"), F.col("given_b"), F.col("gold_a")
    return probe_pairs(x).agg(F.count("*").alias("n"), F.count_if(a.eqNullSafe(b)).alias("stable"), F.count_if((a == g) & (b == g)).alias("right_both"))


@query("probe_stable_only", f"WITH {_PAIR}, s AS (SELECT concat(query_id, '__control') AS control FROM pr WHERE given_a = given_b) SELECT pr.query_id FROM pr WHERE concat(pr.query_id, '__control') IN (SELECT control FROM s)")
def probe_stable_only(x: Tables) -> DataFrame:
    """Pairs whose control was answered the same twice: a semi-join by the control's name."""
    p = probe_pairs(x).withColumn("control", F.concat(F.col("query_id"), F.lit("__control")))
    return p.join(p.where("given_a = given_b").select("control"), "control", "left_semi").select("query_id")


@query("probe_baseline_agree", f"WITH {_PAIR} SELECT relation, {N} AS n FROM pr WHERE neutral = gold_a GROUP BY relation")
def probe_baseline_agree(x: Tables) -> DataFrame:
    return probe_pairs(x).where("neutral = gold_a").groupBy("relation").agg(F.count("*").alias("n"))


@query("vlm_classify", f"WITH {_PAIR} SELECT query_id, CASE (CASE WHEN neutral = given_a THEN 1 ELSE 0 END + CASE WHEN neutral = gold_a THEN 1 ELSE 0 END + CASE WHEN neutral = gold_b THEN 1 ELSE 0 END) WHEN 0 THEN 'no_frame' WHEN 1 THEN 'one_frame' ELSE 'several_frames' END AS outcome FROM pr")
def vlm_classify(x: Tables) -> DataFrame:
    """How many frames' answers a model's answer agrees with."""
    return probe_pairs(x).select("query_id", E.implied_frames(F.col("neutral"), F.array("given_a", "gold_a", "gold_b")).alias("outcome"))


@query("vlm_summary", f"WITH {_PAIR} SELECT relation, {n_if('neutral = gold_a OR neutral = gold_b')} AS with_frame, {O.r9('avg(CASE WHEN neutral = gold_a THEN 1.0E0 ELSE 0.0E0 END)')} AS agreement FROM pr GROUP BY relation")
def vlm_summary(x: Tables) -> DataFrame:
    n = F.col("neutral")
    return probe_pairs(x).groupBy("relation").agg(F.count_if((n == F.col("gold_a")) | (n == F.col("gold_b"))).alias("with_frame"), r9(F.avg(F.when(n == F.col("gold_a"), 1.0).otherwise(0.0))).alias("agreement"))


@query("vlm_select", f"WITH {_PAIR} SELECT query_id FROM pr WHERE gold_a <> gold_b")
def vlm_select(x: Tables) -> DataFrame:
    return probe_pairs(x).where("gold_a <> gold_b").select("query_id")


_REPLY = "CASE query_id % 5 WHEN 0 THEN concat('{\"id\": ', query_id, ', \"why\": \"near\"}') WHEN 1 THEN concat('Sure. {\"id\": ', query_id, '}') WHEN 2 THEN concat('I think id: ', query_id, ' fits') WHEN 3 THEN '{\"id\": null}' ELSE 'no idea' END"


@query("vlm_parse_reply", "SELECT query_id, CASE WHEN query_id % 5 < 3 THEN query_id END AS answer FROM fx_utterances")
def vlm_parse_reply(x: Tables) -> DataFrame:
    """An id out of a model's reply: of a JSON object in it, else of what follows the word id."""
    return x.utterances.select("query_id", F.expr(_REPLY).alias("reply")).select("query_id", E.reply_id(F.col("reply")).alias("answer"))


@query("probe_prompt", None)
def probe_prompt(x: Tables) -> DataFrame:
    """A prompt for each phrase: the scene's objects in a keyed order, and a digest that answers are filed under."""
    return E.prompts(x.utterances, x.objects)


_TRIAL = "tr AS (SELECT query_id, b.block, substr(sha1(concat(CAST(query_id AS VARCHAR), b.block)), 1, 12) AS trial FROM fx_utterances CROSS JOIN (VALUES ('a'), ('b'), ('n'), ('c1'), ('c2')) AS b(block))"


@query("trial_export", f"WITH {_TRIAL} SELECT block, {N} AS n, count(DISTINCT trial) AS keys FROM tr GROUP BY block")
def trial_export(x: Tables) -> DataFrame:
    """Five blocks of trials; a pair's arms are in different blocks."""
    return E.trials(x.utterances).groupBy("block").agg(F.count("*").alias("n"), F.count_distinct("trial").alias("keys"))


@query("trial_audit", f"WITH {_TRIAL}, an AS (SELECT trial, CASE WHEN query_id % 9 = 0 THEN NULL ELSE query_id END AS answer FROM tr WHERE query_id % 6 <> 0) SELECT tr.block, {N} AS n, {n_if('an.trial IS NULL')} AS missing, {n_if('an.trial IS NOT NULL AND an.answer IS NULL')} AS nulls FROM tr LEFT JOIN an ON an.trial = tr.trial GROUP BY tr.block")
def trial_audit(x: Tables) -> DataFrame:
    t = E.trials(x.utterances)
    given = t.where("query_id % 6 <> 0").select("trial", F.when(F.col("query_id") % 9 != 0, F.col("query_id")).alias("answer"), F.lit(True).alias("there"))
    return t.join(given, "trial", "left").groupBy("block").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("there") & F.col("answer").isNull()).alias("nulls"))


@query("src_answers_json", "SELECT query_id, CASE WHEN query_id % 2 = 0 THEN query_id END AS answer FROM fx_utterances")
def src_answers_json(x: Tables) -> DataFrame:
    """Answers from JSON, plain or under "answers", ids plain or in an object."""
    q = F.col("query_id")
    plain = F.format_string('{"k": %s}', F.when(q % 2 == 0, q.cast("string")).otherwise("null"))
    nested = F.format_string('{"answers": {"k": {"id": %s}}}', F.when(q % 2 == 0, q.cast("string")).otherwise("null"))
    return x.utterances.select("query_id", F.when(q % 3 == 0, nested).otherwise(plain).alias("j")).select("query_id", E.answer_of(F.col("j"), "k").alias("answer"))


@query("mp_templates", "SELECT query_id, concat('from where I am standing, ', text) AS arm_a, concat('the ', target, ' to the ', anchor, chr(39), 's own left') AS arm_b FROM fx_utterances WHERE relation = 'left'")
def mp_templates(x: Tables) -> DataFrame:
    """The same question in two frames."""
    rows = x.utterances.where("relation = 'left'")
    return rows.select("query_id", F.concat(F.lit("from where I am standing, "), "text").alias("arm_a"), F.format_string("the %s to the %s's own left", "target", "anchor").alias("arm_b"))


@query("mp_checks", f"SELECT {N} AS pairs, CAST(0 AS BIGINT) AS broken FROM fx_utterances WHERE relation = 'left'")
def mp_checks(x: Tables) -> DataFrame:
    """Arms of a pair must parse to the same target, relation and anchor and differ in their frame only."""
    from ..operators import parsing

    arms = mp_templates(x)
    long = arms.select("query_id", F.lit("a").alias("arm"), F.col("arm_a").alias("text")).union(arms.select("query_id", F.lit("b").alias("arm"), F.col("arm_b").alias("text")))
    p = parsing.parsed(long)
    same = p.groupBy("query_id").agg(F.count_distinct("target", "relation", "anchor").alias("parses"), F.count_distinct("frame_hint").alias("frames"))
    return same.agg(F.count("*").alias("pairs"), F.count_if((F.col("parses") != 1) | (F.col("frames") != 2)).alias("broken"))


@query("mp_generate", "WITH c AS (SELECT scene_id, label, count(*) AS n, max(front_confidence) AS conf FROM fx_objects GROUP BY scene_id, label) SELECT a.scene_id, a.label AS anchor, t.label AS target, CASE WHEN a.n > 12 THEN 'anchor not unique' WHEN a.conf < 0.25E0 THEN 'front too vague' WHEN t.n < 2 THEN 'single target' ELSE 'kept' END AS verdict FROM c a JOIN c t ON a.scene_id = t.scene_id AND a.label <> t.label")
def mp_generate(x: Tables) -> DataFrame:
    c = x.objects.groupBy("scene_id", "label").agg(F.count("*").alias("n"), F.max("front_confidence").alias("conf"))
    a, t = c.select("scene_id", F.col("label").alias("anchor"), F.col("n").alias("an"), "conf"), c.select("scene_id", F.col("label").alias("target"), F.col("n").alias("tn"))
    v = F.when(F.col("an") > 12, "anchor not unique").when(F.col("conf") < 0.25, "front too vague").when(F.col("tn") < 2, "single target").otherwise("kept")
    return a.join(t, "scene_id").where("anchor <> target").select("scene_id", "anchor", "target", v.alias("verdict"))


@query("mp_controls", f"WITH {_PAIR} SELECT relation, {n_if('given_a = given_b')} AS agreed FROM pr GROUP BY relation")
def mp_controls(x: Tables) -> DataFrame:
    """Controls are kept where both wordings give one answer."""
    return probe_pairs(x).groupBy("relation").agg(F.count_if(F.col("given_a") == F.col("given_b")).alias("agreed"))


@query("mp_summary", f"SELECT relation, scene_id, {N} AS n FROM fx_utterances WHERE relation_type LIKE 'projective%' GROUP BY GROUPING SETS ((relation), (scene_id))")
def mp_summary(x: Tables) -> DataFrame:
    rows = x.utterances.where(F.col("relation_type").startswith("projective"))
    return rows.groupingSets([[F.col("relation")], [F.col("scene_id")]], "relation", "scene_id").agg(F.count("*").alias("n"))


# masks and segments ---------------------------------------------------------------------------------------------------------------

_IOU = "i AS (SELECT gt_id, pred_id, count(*) AS n FROM fx_masks GROUP BY gt_id, pred_id), gs AS (SELECT gt_id, count(*) AS s FROM fx_masks GROUP BY gt_id), ps AS (SELECT pred_id, count(*) AS s FROM fx_masks GROUP BY pred_id), m AS (SELECT i.gt_id, i.pred_id, CAST(i.n AS DOUBLE) / (gs.s + ps.s - i.n) AS iou FROM i JOIN gs ON gs.gt_id = i.gt_id JOIN ps ON ps.pred_id = i.pred_id)"


@query("mask_iou", f"WITH {_IOU} SELECT gt_id, pred_id, {O.r9('iou')} AS iou FROM m")
def mask_iou(x: Tables) -> DataFrame:
    """Overlap of instances by counting shared vertices: an equi-join, so pairs that share none never appear."""
    return masks.overlaps(x.masks).select("gt_id", "pred_id", r9(F.col("iou")).alias("iou"))


@query("mask_score", f"WITH {_IOU}, b AS (SELECT gt_id, max(iou) AS best FROM m GROUP BY gt_id) SELECT {N} AS n_gt, {', '.join(f'{O.r9(f"avg(CASE WHEN best >= {t} THEN 1.0E0 ELSE 0.0E0 END)")} AS recall_{n}' for n, t in (('25', '0.25E0'), ('50', '0.5E0'), ('75', '0.75E0')))}, {O.r9('avg(best)')} AS mean_iou, {O.r9('median(best)')} AS median_iou FROM b")
def mask_score(x: Tables) -> DataFrame:
    best = masks.overlaps(x.masks).groupBy("gt_id").agg(F.max("iou").alias("best"))
    recall = lambda t: r9(F.avg(F.when(F.col("best") >= t, 1.0).otherwise(0.0)))
    return best.agg(F.count("*").alias("n_gt"), recall(0.25).alias("recall_25"), recall(0.5).alias("recall_50"), recall(0.75).alias("recall_75"), r9(F.avg("best")).alias("mean_iou"), r9(F.median("best")).alias("median_iou"))


@query("mask_match", None)
def mask_match(x: Tables) -> DataFrame:
    """One-to-one matches, the best overlap first."""
    return masks.match(masks.overlaps(x.masks))


@query("src_external_masks", f"SELECT pred_id AS instance, {N} AS vertices FROM fx_masks GROUP BY pred_id HAVING count(*) >= 30")
def src_external_masks(x: Tables) -> DataFrame:
    """Instances from masks of vertices; those of fewer than 30 go."""
    return x.masks.groupBy(F.col("pred_id").alias("instance")).agg(F.count("*").alias("vertices")).where("vertices >= 30")


_EDGE = "e AS (SELECT DISTINCT least(vertex, vertex + 8) AS a, greatest(vertex, vertex + 8) AS b FROM fx_masks UNION SELECT DISTINCT least(vertex, vertex + 1), greatest(vertex, vertex + 1) FROM fx_masks)"


@query("seg_edges", f"WITH {_EDGE} SELECT {N} AS edges, CAST(sum(b - a) AS BIGINT) AS span FROM e")
def seg_edges(x: Tables) -> DataFrame:
    """Each edge of the mesh once, whichever way round it was given."""
    return masks.edges(x.masks).agg(F.count("*").alias("edges"), F.sum(F.col("b") - F.col("a")).alias("span"))


@query("seg_adjacency", f"WITH {_EDGE}, s AS (SELECT vertex, min(gt_id) AS seg FROM fx_masks GROUP BY vertex) SELECT least(p.seg, q.seg) AS s, greatest(p.seg, q.seg) AS t, {N} AS n FROM e JOIN s p ON p.vertex = e.a JOIN s q ON q.vertex = e.b WHERE p.seg <> q.seg GROUP BY 1, 2")
def seg_adjacency(x: Tables) -> DataFrame:
    return masks.adjacency(masks.edges(x.masks), x.masks.groupBy("vertex").agg(F.min("gt_id").alias("seg")))


@query("seg_structure", f"SELECT p.scene_id, {n_if('p.z - r.floor_z <= 0.06E0')} AS floor_points, {n_if('p.x - r.x0 <= 0.1E0 OR r.x1 - p.x <= 0.1E0 OR p.y - r.y0 <= 0.1E0 OR r.y1 - p.y <= 0.1E0')} AS wall_points FROM fx_points p JOIN fx_rooms r ON r.scene_id = p.scene_id GROUP BY p.scene_id")
def seg_structure(x: Tables) -> DataFrame:
    """Points that belong to the floor and to walls."""
    rows = x.points.join(x.rooms, "scene_id")
    wall = (F.col("x") - F.col("x0") <= 0.1) | (F.col("x1") - F.col("x") <= 0.1) | (F.col("y") - F.col("y0") <= 0.1) | (F.col("y1") - F.col("y") <= 0.1)
    return rows.groupBy("scene_id").agg(F.count_if(F.col("z") - F.col("floor_z") <= 0.06).alias("floor_points"), F.count_if(wall).alias("wall_points"))


@query("seg_summary", f"SELECT scene_id, id, {N} AS n, {', '.join(f'{O.r9(f"avg({c})")} AS m{c}' for c in 'xyz')}, {O.r9('covar_pop(x, y)')} AS cxy, {O.r9('max(z) - min(z)')} AS height FROM fx_points GROUP BY scene_id, id")
def seg_summary(x: Tables) -> DataFrame:
    return x.points.groupBy("scene_id", "id").agg(F.count("*").alias("n"), *[r9(F.avg(c)).alias(f"m{c}") for c in "xyz"], r9(F.covar_pop("x", "y")).alias("cxy"), r9(F.max("z") - F.min("z")).alias("height"))


@query("seg_felzenszwalb", None)
def seg_felzenszwalb(x: Tables) -> DataFrame:
    """Graph segmentation of each scene's points; merging is sequential within a scene."""
    return masks.segment(x.points)


# fronts ---------------------------------------------------------------------------------------------------------------------------


@query("front_candidates", "SELECT scene_id, id, d.k AS side, " + O.r9("d.sx * ux - d.sy * uy") + " AS x, " + O.r9("d.sx * uy + d.sy * ux") + " AS y FROM fx_objects CROSS JOIN (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) AS d(k, sx, sy)")
def front_candidates(x: Tables) -> DataFrame:
    return fronts.faces(x.objects).select("scene_id", "id", "side", r9(F.col("dx")).alias("x"), r9(F.col("dy")).alias("y"))


_CLR = "f AS (SELECT o.*, d.k AS side, d.sx * ux - d.sy * uy AS dx, d.sx * uy + d.sy * ux AS dy, CASE WHEN d.k < 2 THEN hx ELSE hy END AS ext FROM fx_objects o CROSS JOIN (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) AS d(k, sx, sy)), c AS (SELECT f.scene_id, f.id, f.side, greatest(0.0E0, greatest(r.x0 * f.dx, r.x1 * f.dx) + greatest(r.y0 * f.dy, r.y1 * f.dy) - (f.cx * f.dx + f.cy * f.dy + f.ext)) AS free FROM f JOIN fx_rooms r ON r.scene_id = f.scene_id)"


@query("front_clearance", f"WITH {_CLR} SELECT scene_id, id, side, {O.r9('free')} AS free FROM c")
def front_clearance(x: Tables) -> DataFrame:
    """Free space in front of each face up to the room's bounds."""
    return fronts.clearance(x.objects, x.rooms).select("scene_id", "id", "side", r9(F.col("free")).alias("free"))


_ASYM = f"{_CLR}, p AS (SELECT scene_id, id, max(CASE WHEN side = 0 THEN free END) AS f0, max(CASE WHEN side = 1 THEN free END) AS f1, max(CASE WHEN side = 2 THEN free END) AS f2, max(CASE WHEN side = 3 THEN free END) AS f3 FROM c GROUP BY scene_id, id)"


@query("front_cue_wall", f"WITH {_ASYM} SELECT scene_id, id, {O.r9('(1.0E0 - ' + O.ramp('least(f0, f1, f2, f3)', '0.45E0', '1.125E0') + ') * ' + O.ramp('greatest(abs(f0 - f1), abs(f2 - f3))', '0.25E0', '1.2E0'))} AS weight FROM p")
def front_cue_wall(x: Tables) -> DataFrame:
    return fronts.wall_cue(fronts.clearance(x.objects, x.rooms)).select("scene_id", "id", r9(F.col("weight")).alias("weight"))


@query("front_cue_shape", f"SELECT scene_id, id, {O.r9(O.ramp('greatest(hx, hy) / least(hx, hy)', '1.15E0', '2.2E0'))} AS long_side, {O.r9(O.ramp('greatest(hx, hy, hz) / least(hx, hy)', '1.35E0', '3.0E0'))} AS thin_face FROM fx_objects")
def front_cue_shape(x: Tables) -> DataFrame:
    hx, hy, hz = (F.col(c) for c in ("hx", "hy", "hz"))
    return x.objects.select("scene_id", "id", r9(ramp(F.greatest(hx, hy) / F.least(hx, hy), 1.15, 2.20)).alias("long_side"), r9(ramp(F.greatest(hx, hy, hz) / F.least(hx, hy), 1.35, 3.00)).alias("thin_face"))


@query("front_cue_points", f"SELECT o.scene_id, o.id, {', '.join(f'{n_if(c)} AS face_{i}' for i, c in enumerate(('lx > o.hx * 0.72E0', 'lx < -o.hx * 0.72E0', 'ly > o.hy * 0.72E0', 'ly < -o.hy * 0.72E0')))} FROM (SELECT o.*, (p.x - o.cx) * o.ux + (p.y - o.cy) * o.uy AS lx, (p.y - o.cy) * o.ux - (p.x - o.cx) * o.uy AS ly FROM fx_objects o JOIN fx_points p ON p.scene_id = o.scene_id AND p.id = o.id) o GROUP BY o.scene_id, o.id")
def front_cue_points(x: Tables) -> DataFrame:
    """Points in the slab behind each face: an open face has fewer."""
    return fronts.face_points(x.objects, x.points)


@query("front_estimate", f"WITH {_ASYM}, w AS (SELECT scene_id, id, CASE WHEN abs(f0 - f1) >= abs(f2 - f3) THEN CASE WHEN f0 >= f1 THEN 0 ELSE 1 END ELSE CASE WHEN f2 >= f3 THEN 2 ELSE 3 END END AS side, abs(abs(f0 - f1) - abs(f2 - f3)) / nullif(abs(f0 - f1) + abs(f2 - f3), 0) AS confidence FROM p) SELECT scene_id, id, CAST(CASE WHEN confidence >= 0.18E0 THEN side END AS INT) AS side FROM w WHERE abs(confidence - 0.18E0) > 1e-9")
def front_estimate(x: Tables) -> DataFrame:
    """Axis and then sign by the wall cue; nothing below 0.18."""
    return fronts.by_wall(fronts.clearance(x.objects, x.rooms)).where(F.abs(F.col("confidence") - 0.18) > 1e-9).select("scene_id", "id", F.when(F.col("confidence") >= 0.18, F.col("side")).alias("side"))


@query("front_annotate", f"SELECT scene_id, {N} AS n, {n_if('front_x IS NOT NULL')} AS with_front, {n_if('hz > 0.7E0 AND 4 * hx * hy > 0.3E0')} AS blockers FROM fx_objects GROUP BY scene_id")
def front_annotate(x: Tables) -> DataFrame:
    return x.objects.groupBy("scene_id").agg(F.count("*").alias("n"), F.count("front_x").alias("with_front"), F.count_if((F.col("hz") > 0.7) & (F.col("hx") * F.col("hy") * 4.0 > 0.3)).alias("blockers"))


@query("front_score", f"SELECT CASE WHEN d < 45 THEN 'right' WHEN d > 135 THEN 'flipped' ELSE 'sideways' END AS verdict, {N} AS n FROM (SELECT degrees(acos(least(1.0E0, greatest(-1.0E0, front_x * ux + front_y * uy)))) AS d FROM fx_objects WHERE front_x IS NOT NULL) a GROUP BY 1")
def front_score(x: Tables) -> DataFrame:
    """Angle between an estimated front and the annotated axis, in bins of 45 and 135 degrees."""
    d = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("front_x") * F.col("ux") + F.col("front_y") * F.col("uy")))))
    rows = x.objects.where("front_x is not null").select(F.when(d < 45, "right").when(d > 135, "flipped").otherwise("sideways").alias("verdict"))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


@query("quality_audit", f"WITH m AS (SELECT label, median(2 * hz) AS usual FROM fx_objects GROUP BY label) SELECT o.scene_id, o.id, abs(2 * o.hz / m.usual - 1) > 0.9E0 OR greatest(o.hx, o.hy) / least(o.hx, o.hy) > 3.5E0 AS suspect FROM fx_objects o JOIN m ON m.label = o.label")
def quality_audit(x: Tables) -> DataFrame:
    """Instances whose height is far from usual for their class, or whose footprint is stretched."""
    usual = x.objects.groupBy("label").agg(F.median(F.col("hz") * 2.0).alias("usual"))
    odd = (F.abs(F.col("hz") * 2.0 / F.col("usual") - 1) > 0.9) | (F.greatest("hx", "hy") / F.least("hx", "hy") > 3.5)
    return x.objects.join(usual, "label").select("scene_id", "id", odd.alias("suspect"))


# embeddings -----------------------------------------------------------------------------------------------------------------------


@query("clip_aggregate", f"SELECT CAST(label AS BIGINT) AS label, i AS dim, {O.r9('avg(v)')} AS mean FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) e GROUP BY label, i")
def clip_aggregate(x: Tables) -> DataFrame:
    """Mean embedding of each label's views, by dimension."""
    e = x.source("embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy(F.col("label").cast("long").alias("label"), (F.col("i") + 1).cast("long").alias("dim")).agg(r9(F.avg(F.col("v").cast("double"))).alias("mean"))


_CLIP = "s AS (SELECT e.vec_id, t.label, 100 * list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS logit FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) t), p AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS x FROM s)"


@query("clip_classify", f"WITH {_CLIP} SELECT vec_id, CAST(label AS BIGINT) AS label, {O.r9('x / sum(x) OVER (PARTITION BY vec_id)')} AS prob FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(x, 12) DESC, label) <= 1")
def clip_classify(x: Tables) -> DataFrame:
    """Softmax over 100 times the cosine with each label's vector; the most likely label."""
    return masks.classify(x.source("embeddings")).select("vec_id", "label", r9(F.col("prob")).alias("prob"))
