"""Queries of the resolver: phrases of the table of utterances against all objects of their scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import r9
from ..operators import resolver
from . import oracle as O
from .catalog import query
from .fixtures import Tables
from .q_relations import _above, _support, _within

_AXES = {
    "egocentric": ("ly", "-lx", "-lx", "-ly"),
    "intrinsic": ("a.front_y", "-a.front_x", "a.front_x", "a.front_y"),
    "addressee": ("-a.front_y", "a.front_x", "a.front_x", "a.front_y"),
    "world": ("1.0E0", "0.0E0", "0.0E0", "1.0E0"),
}


def scored(frame: str = "egocentric") -> str:
    """Common table expressions that end in one named s: query_id, scene_id, relation, relation_type, t_id, a_id, a_rank, value."""
    rx, ry, fx, fy = _AXES[frame]
    near = f"(1.0E0 - {O.ramp('gap', 'd0', '3 * d0')})"
    case = " ".join(f"WHEN relation = '{d}' THEN CASE WHEN veto OR rx IS NULL THEN 0.0E0 ELSE {O.projective_value(d)} END" for d in ("left", "right", "front", "behind"))
    g = "((t.cz - t.hz) - (a.cz + a.hz))"
    return f"""
an AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY scene_id, label ORDER BY hx * hy * hz DESC, id) AS a_rank FROM fx_objects o) r WHERE a_rank <= 6),
j AS (SELECT q.query_id, q.relation, q.relation_type, q.eye_x, q.eye_y, q.target, a.*, (a.cx - q.eye_x) / sqrt((a.cx - q.eye_x) * (a.cx - q.eye_x) + (a.cy - q.eye_y) * (a.cy - q.eye_y)) AS lx, (a.cy - q.eye_y) / sqrt((a.cx - q.eye_x) * (a.cx - q.eye_x) + (a.cy - q.eye_y) * (a.cy - q.eye_y)) AS ly
  FROM fx_utterances q JOIN an a ON a.scene_id = q.scene_id AND a.label = q.anchor),
f AS (SELECT a.*, {rx} AS rx, {ry} AS ry, {fx} AS fx, {fy} AS fy FROM j a),
p AS (SELECT a.query_id, a.scene_id, a.relation, a.relation_type, t.id AS t_id, a.id AS a_id, a.a_rank, a.rx,
  (t.cx - a.cx) * a.rx + (t.cy - a.cy) * a.ry AS px, (t.cx - a.cx) * a.fx + (t.cy - a.cy) * a.fy AS py, {O.radius('t', 'a.rx', 'a.ry')} AS tr0, {O.radius('t', 'a.fx', 'a.fy')} AS tr1, {O.radius('a', 'a.rx', 'a.ry')} AS ar0, {O.radius('a', 'a.fx', 'a.fy')} AS ar1,
  greatest(0.0E0, {O.box_gap('t', 'a')}) AS gap, {O.lap(O.tall('t'), O.tall('a'))} AS zlap, abs(t.cz - a.cz) AS dz, {O.reach('a')} AS a_reach,
  (CASE WHEN {_support('a', 't', '0.12E0', '0.35E0')} > 0.25E0 THEN TRUE WHEN t.hx * t.hy * t.hz > 2 * a.hx * a.hy * a.hz AND {_within('a', 't', '0.02E0')} > 0.75E0 THEN TRUE ELSE FALSE END) AS veto,
  0.3E0 + 0.3E0 * ({O.reach('t')} + {O.reach('a')}) AS d0, sqrt((t.cx - a.cx) * (t.cx - a.cx) + (t.cy - a.cy) * (t.cy - a.cy)) AS flat, {O.lap(O.tall('t'), O.tall('a'))} / (greatest(t.cz + t.hz, a.cz + a.hz) - least(t.cz - t.hz, a.cz - a.hz)) AS ziou,
  {_support('t', 'a', '0.08E0', '0.35E0')} AS s_on, {_above('t', 'a')} AS s_above, {_above('a', 't')} AS s_below, CASE WHEN t.hx * t.hy * t.hz > a.hx * a.hy * a.hz THEN 0.0E0 ELSE {O.ramp(_within('t', 'a', '0.05E0'), '0.3E0', '0.6E0')} END AS s_inside
  FROM f a JOIN fx_objects t ON t.scene_id = a.scene_id AND t.label = a.target),
s AS (SELECT query_id, scene_id, relation, relation_type, t_id, a_id, a_rank, CASE WHEN t_id = a_id THEN 0.0E0 {case} WHEN relation = 'on' THEN s_on WHEN relation = 'above' THEN s_above WHEN relation = 'below' THEN s_below WHEN relation = 'inside' THEN s_inside
  WHEN relation = 'near' THEN {near} WHEN relation = 'next_to' THEN {O.gmean([near, f"greatest(1.0E0 - {O.ramp('dz', '0.35E0', '1.05E0')}, ziou)", O.ramp('flat / (dz + 1e-6)', '0.6E0', '1.5E0')], [1, 0.7, 0.5])} END AS value FROM p)"""


#: From s to the winner of each query: best anchor first, survivors, rank.
_BEST = """
b AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id, t_id ORDER BY round(value, 9) DESC, a_rank) AS n FROM s) x WHERE n = 1),
c AS (SELECT b.*, least(1.0E0, greatest(1e-6, value)) AS score FROM b),
k AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM c),
r AS (SELECT query_id, scene_id, relation, relation_type, t_id, a_id, score, row_number() OVER w AS rank, lead(score) OVER w AS second FROM k WHERE score > 1e-3 OR top <= 1e-3 WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, t_id))"""


@query("rel_dispatch", f"WITH {scored()} SELECT query_id, t_id AS target_id, a_id AS anchor_id, {O.r9('value')} AS score FROM s")
def rel_dispatch(x: Tables) -> DataFrame:
    """Each phrase's own relation between its class and its anchor's class: a branch for each family, pruned by what the batch asks for."""
    return resolver.scored_pairs(x.utterances, x.objects, x.rooms).select("query_id", F.col("t_id").alias("target_id"), F.col("a_id").alias("anchor_id"), r9(F.col("value")).alias("score"))


@query("constraint_apply", f"WITH {scored()},{_BEST.rstrip()} SELECT query_id, t_id AS target_id, {O.r9('score')} AS score FROM c")
def constraint_apply(x: Tables) -> DataFrame:
    """For each candidate the best score over its query's anchors."""
    best = resolver.combine(resolver.best_anchor(resolver.scored_pairs(x.utterances, x.objects, x.rooms)))
    return best.select("query_id", "target_id", r9(F.col("score")).alias("score"))


@query("candidate_combine", f"WITH {scored()},{_BEST.rstrip()} SELECT query_id, t_id AS target_id, {O.r9('score')} AS score FROM c")
def candidate_combine(x: Tables) -> DataFrame:
    """Relation terms times label agreement (1 here: classes match exactly)."""
    best = resolver.combine(resolver.best_anchor(resolver.scored_pairs(x.utterances, x.objects, x.rooms)), F.lit(1.0))
    return best.select("query_id", "target_id", r9(F.col("score")).alias("score"))


@query("survivor_filter", f"WITH {scored()},{_BEST.rstrip()} SELECT query_id, count(*) AS survivors, {O.r9('max(score)')} AS best FROM r GROUP BY query_id")
def survivor_filter(x: Tables) -> DataFrame:
    rows = resolver.ranked(resolver.combine(resolver.best_anchor(resolver.scored_pairs(x.utterances, x.objects, x.rooms))))
    return rows.groupBy("query_id").agg(F.count("*").alias("survivors"), r9(F.max("score")).alias("best"))


_FLAGS = "(score > 1e-9 AND score - second <= greatest(0.04E0, 0.08E0 * score)) IS TRUE"


@query("resolve", f"WITH {scored()},{_BEST.rstrip()} SELECT query_id, scene_id, {O.r9('score')} AS score, {O.r9('second')} AS second, {_FLAGS} AS score_tie, score < 0.12E0 AS weak_match FROM r WHERE rank = 1")
def resolve(x: Tables) -> DataFrame:
    """The answer's score, the runner-up's, and the flags of each query; ids of exact ties are left to resolve_answers."""
    rows = resolver.resolve(x.utterances, x.objects, x.rooms)
    return rows.select("query_id", "scene_id", r9(F.col("score")).alias("score"), r9(F.col("second")).alias("second"), "score_tie", "weak_match")


@query("resolve_answers", f"WITH {scored()},{_BEST.rstrip()} SELECT query_id, t_id AS target_id FROM r WHERE rank = 1 AND (second IS NULL OR score - second > 1e-6) AND score > 1e-6")
def resolve_answers(x: Tables) -> DataFrame:
    """The object that each query means, where one candidate is ahead."""
    return resolver.resolve(x.utterances, x.objects, x.rooms).where("(second is null or score - second > 1e-6) and score > 1e-6").select("query_id", "target_id")


_ODD = "CASE WHEN query_id % 5 = 0 THEN 'helicopter' ELSE target END AS target, CASE WHEN query_id % 5 = 1 THEN 'helicopter' WHEN query_id % 5 <> 2 THEN anchor END AS anchor, CASE WHEN query_id % 5 <> 2 THEN relation END AS relation"


@query(
    "resolve_every",
    f"WITH {scored()},{_BEST.rstrip()}, q AS (SELECT query_id, scene_id, {_ODD} FROM fx_utterances), l AS (SELECT scene_id, label, count(*) AS n FROM fx_objects GROUP BY scene_id, label), "
    "v AS (SELECT q.query_id, t.n IS NULL OR (q.relation IS NOT NULL AND g.n IS NULL) AS no_candidate, CASE WHEN t.n IS NULL THEN NULL WHEN q.relation IS NULL THEN 1.0E0 WHEN g.n IS NULL THEN 1E-6 ELSE r.score END AS score, "
    "CASE WHEN t.n IS NULL THEN NULL WHEN q.relation IS NULL THEN CASE WHEN t.n > 1 THEN 1.0E0 END WHEN g.n IS NULL THEN CASE WHEN t.n > 1 THEN 1E-6 END ELSE r.second END AS second "
    "FROM q LEFT JOIN l t ON t.scene_id = q.scene_id AND t.label = q.target LEFT JOIN l g ON g.scene_id = q.scene_id AND g.label = q.anchor LEFT JOIN (SELECT * FROM r WHERE rank = 1) r ON r.query_id = q.query_id) "
    f"SELECT query_id, no_candidate, {O.r9('score')} AS score, {O.r9('second')} AS second, {_FLAGS} AS score_tie, (score < 0.12E0) IS TRUE AS weak_match FROM v",
)
def resolve_every(x: Tables) -> DataFrame:
    """A row for every phrase, some of which are asked for a class or an anchor that no scene has, or without a relation."""
    m = F.col("query_id") % 5
    odd = x.utterances.withColumns({"target": F.when(m == 0, "helicopter").otherwise(F.col("target")), "anchor": F.when(m == 1, "helicopter").when(m != 2, F.col("anchor")), "relation": F.when(m != 2, F.col("relation"))})
    rows = resolver.every(odd, x.objects, x.rooms)
    return rows.select("query_id", "no_candidate", r9(F.col("score")).alias("score"), r9(F.col("second")).alias("second"), "score_tie", "weak_match")


for _k in ("intrinsic", "addressee", "world"):

    @query(f"resolve_{_k}", f"WITH {scored(_k)},{_BEST.rstrip()} SELECT query_id, {O.r9('score')} AS score, score < 0.12E0 AS no_answer FROM r WHERE rank = 1")
    def _forced(x: Tables, k: str = _k) -> DataFrame:
        rows = resolver.resolve(x.utterances, x.objects, x.rooms, k)
        return rows.select("query_id", r9(F.col("score")).alias("score"), F.col("weak_match").alias("no_answer"))


_FORCED = ", ".join(f"f_{k} AS (WITH {scored(k)},{_BEST.rstrip()} SELECT query_id, relation_type, '{k}' AS kind, CASE WHEN score >= 0.12E0 AND (second IS NULL OR score - second > 1e-6) THEN t_id END AS answer, {O.r9('score')} AS score FROM r WHERE rank = 1)" for k in _AXES)


@query("resolve_force_frame", f"WITH {_FORCED} {' UNION ALL '.join(f'SELECT * FROM f_{k}' for k in _AXES)}")
def resolve_force_frame(x: Tables) -> DataFrame:
    """All four frames at once: the kind is a join key, so frames are rows of one plan and not runs of it."""
    rows = resolver.under_frames(x.utterances, x.objects, x.rooms)
    return rows.select("query_id", "relation_type", "kind", "answer", r9(F.col("score")).alias("score"))


@query("amb_score_tie", f"WITH {scored()},{_BEST.rstrip()} SELECT relation, count(*) AS queries, CAST(count_if({_FLAGS}) AS BIGINT) AS tied FROM r WHERE rank = 1 GROUP BY relation")
def amb_score_tie(x: Tables) -> DataFrame:
    return resolver.resolve(x.utterances, x.objects, x.rooms).groupBy("relation").agg(F.count("*").alias("queries"), F.count_if("score_tie").alias("tied"))


@query("amb_weak_match", f"WITH {scored()},{_BEST.rstrip()} SELECT relation, CAST(count_if(score < 0.12E0) AS BIGINT) AS weak FROM r WHERE rank = 1 GROUP BY relation")
def amb_weak_match(x: Tables) -> DataFrame:
    return resolver.resolve(x.utterances, x.objects, x.rooms).groupBy("relation").agg(F.count_if("weak_match").alias("weak"))


@query(
    "anchor_resolve",
    "SELECT scene_id, label AS anchor, a_rank, id AS anchor_id FROM (SELECT o.*, row_number() OVER (PARTITION BY scene_id, label ORDER BY hx * hy * hz DESC, id) AS a_rank FROM fx_objects o) r WHERE a_rank <= 6",
)
def anchor_resolve(x: Tables) -> DataFrame:
    """The at most six anchors of each class and scene: equally good ones by volume."""
    w = Window.partitionBy("scene_id", "label").orderBy((F.col("hx") * F.col("hy") * F.col("hz")).desc(), "id")
    return x.objects.withColumn("a_rank", F.row_number().over(w)).where("a_rank <= 6").select("scene_id", F.col("label").alias("anchor"), F.col("a_rank").cast("long").alias("a_rank"), F.col("id").alias("anchor_id"))


@query(
    "amb_anchor",
    "SELECT q.query_id, count(*) AS alternatives, count(*) > 1 AS flagged FROM fx_utterances q JOIN fx_objects a ON a.scene_id = q.scene_id AND a.label = q.anchor GROUP BY q.query_id",
)
def amb_anchor(x: Tables) -> DataFrame:
    """Anchors of a bare class all match equally well, so more than one is an ambiguity."""
    a = x.objects.groupBy("scene_id", F.col("label").alias("anchor")).agg(F.count("*").alias("alternatives"))
    return x.utterances.join(a, ["scene_id", "anchor"]).select("query_id", "alternatives", (F.col("alternatives") > 1).alias("flagged"))


@query("class_candidates", "SELECT q.query_id, count(*) AS candidates, min(o.id) AS first_id FROM fx_utterances q JOIN fx_objects o ON o.scene_id = q.scene_id AND o.label = q.target GROUP BY q.query_id")
def class_candidates(x: Tables) -> DataFrame:
    c = x.objects.groupBy("scene_id", F.col("label").alias("target")).agg(F.count("*").alias("candidates"), F.min("id").alias("first_id"))
    return x.utterances.join(c, ["scene_id", "target"]).select("query_id", "candidates", "first_id")


@query(
    "amb_no_candidate",
    "SELECT q.query_id FROM (SELECT query_id, scene_id, CASE WHEN query_id % 3 = 0 THEN 'lamp' ELSE target END AS target FROM fx_utterances) q WHERE NOT EXISTS (SELECT 1 FROM fx_objects o WHERE o.scene_id = q.scene_id AND o.label = q.target)",
)
def amb_no_candidate(x: Tables) -> DataFrame:
    """Queries whose class the scene doesn't have; a third of the phrases are asked for a lamp to make some."""
    q = x.utterances.select("query_id", "scene_id", F.when(F.col("query_id") % 3 == 0, "lamp").otherwise(F.col("target")).alias("label"))
    return q.join(x.objects, ["scene_id", "label"], "left_anti").select("query_id")


_ALL = ", ".join(f"{k[:3]} AS (WITH {scored(k)},{_BEST.rstrip()} SELECT query_id, relation_type, CASE WHEN score >= 0.12E0 AND (second IS NULL OR score - second > 1e-6) THEN t_id END AS answer FROM r WHERE rank = 1)" for k in _AXES)
_FOUR = f"WITH {_ALL}, m AS (SELECT e.query_id, e.relation_type, e.answer AS egocentric, i.answer AS intrinsic, a.answer AS addressee, w.answer AS world FROM ego e JOIN int i USING (query_id) JOIN adr a USING (query_id) JOIN wor w USING (query_id) WHERE e.relation_type LIKE 'projective%')".replace("add AS (", "adr AS (").replace("int AS (", "itr AS (").replace("JOIN int i", "JOIN itr i")


@query("frame_answers", f"{_FOUR} SELECT query_id, egocentric, intrinsic, addressee, world FROM m")
def frame_answers(x: Tables) -> DataFrame:
    """The answer under each frame, null where there is none or none is ahead."""
    return resolver.answers(x.utterances, x.objects, x.rooms).select("query_id", "egocentric", "intrinsic", "addressee", "world")


_DISTINCT = "(SELECT count(DISTINCT v) FROM (VALUES (egocentric), (intrinsic), (addressee), (world)) AS z(v))"


@query("amb_frame", f"{_FOUR} SELECT query_id, {_DISTINCT} AS answers, {_DISTINCT} >= 2 AS disagree FROM m")
def amb_frame(x: Tables) -> DataFrame:
    """Whether frames that have an answer give at least two different ones."""
    rows = resolver.answers(x.utterances, x.objects, x.rooms)
    n = F.size(F.array_distinct(F.array_compact(F.array("egocentric", "intrinsic", "addressee", "world"))))
    return rows.select("query_id", n.cast("long").alias("answers"), (n >= 2).alias("disagree"))


@query(
    "sens_summarise",
    f"{_FOUR} SELECT relation_type, count(*) AS n, CAST(count_if({_DISTINCT} >= 2) AS BIGINT) AS disagreed, CAST(count_if(egocentric IS DISTINCT FROM intrinsic) AS BIGINT) AS flips_intrinsic, CAST(count_if(egocentric IS DISTINCT FROM addressee) AS BIGINT) AS flips_addressee, CAST(count_if(egocentric IS DISTINCT FROM world) AS BIGINT) AS flips_world, "
    "CAST(count_if(egocentric <> world AND egocentric IS NOT NULL AND world IS NOT NULL) AS BIGINT) AS changed_world FROM m GROUP BY relation_type",
)
def sens_summarise(x: Tables) -> DataFrame:
    """Disagreement and flips against fixed frames by relation type; a missing answer is a flip but no disagreement."""
    rows = resolver.answers(x.utterances, x.objects, x.rooms)
    n = F.size(F.array_distinct(F.array_compact(F.array("egocentric", "intrinsic", "addressee", "world"))))
    flip = lambda k: F.count_if(~F.col("egocentric").eqNullSafe(F.col(k)))
    return rows.groupBy("relation_type").agg(
        F.count("*").alias("n"), F.count_if(n >= 2).alias("disagreed"), flip("intrinsic").alias("flips_intrinsic"), flip("addressee").alias("flips_addressee"), flip("world").alias("flips_world"),
        F.count_if(F.col("egocentric") != F.col("world")).alias("changed_world"),
    )


@query("sens_measure", f"{_FOUR} SELECT query_id, relation_type, egocentric AS policy, world FROM m")
def sens_measure(x: Tables) -> DataFrame:
    rows = resolver.answers(x.utterances, x.objects, x.rooms)
    return rows.select("query_id", "relation_type", F.col("egocentric").alias("policy"), "world")


@query("rob_sweep", None)
def rob_sweep(x: Tables) -> DataFrame:
    """Disagreement under jittered thresholds: trials are rows of one plan."""
    return resolver.sweep(x.utterances.where("relation_type like 'projective%'"), x.objects, x.rooms)
