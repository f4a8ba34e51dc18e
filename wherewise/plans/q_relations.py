"""Queries of the relation scorers: every ordered pair of objects of every scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, box_gap, overlap_share, prefixed, r9
from ..operators import frames
from ..operators import relations as R
from . import oracle as O
from .catalog import query
from .fixtures import Tables

T, A = R.T, R.A


def ids() -> list:
    return [F.col("scene_id"), F.col("t_id").alias("target_id"), F.col("a_id").alias("anchor_id")]


def pairs(x: Tables) -> DataFrame:
    """Targets and anchors of a scene: an equi-join on the scene, so each scene is one partition's work."""
    t, a = prefixed(x.objects, "t", ("scene_id",)), prefixed(x.objects, "a", ("scene_id",))
    return t.join(a, "scene_id").where("t_id <> a_id")


def seen(x: Tables) -> DataFrame:
    """Pairs with the egocentric axes at the anchor, from the viewer's place (3, -1)."""
    return R.with_frame_spans(frames.with_egocentric(pairs(x), F.lit(3.0), F.lit(-1.0)))


def _ego(columns: str) -> str:
    return f"WITH p AS ({O.framed('a.ly', '-a.lx', '-a.lx', '-a.ly', O.EGO)}) SELECT scene_id, target_id, anchor_id, {columns} FROM p"


for _d in R.DIRECTIONS:

    @query(f"rel_{_d}", _ego(f"{O.r9(O.projective_value(_d))} AS score"))
    def _projective(x: Tables, d: str = _d) -> DataFrame:
        return R.facing(seen(x), d).select(*ids(), r9(R.projective()).alias("score"))


@query("rel_projective_terms", _ego(", ".join(f"{O.r9(v)} AS {k}" for k, v in O.projective("left").items())))
def rel_projective_terms(x: Tables) -> DataFrame:
    return R.facing(seen(x), "left").select(*ids(), *[r9(v).alias(k) for k, v in R.projective_terms().items()])


@query("rel_axis_value", _ego("round(px, 9) + 0.0E0 AS lateral, round(py, 9) + 0.0E0 AS frontal"))
def rel_axis_value(x: Tables) -> DataFrame:
    return seen(x).select(*ids(), r9(F.col("px")).alias("lateral"), r9(F.col("py")).alias("frontal"))


def _simple(key: str, sql: str, score) -> None:
    @query(key, O.pairs(f"{O.r9(sql)} AS score"))
    def run(x: Tables) -> DataFrame:
        return pairs(x).select(*ids(), r9(score()).alias("score"))


def _support(t: str, s: str, tol: str, least: str) -> str:
    g = f"(({t}.cz - {t}.hz) - ({s}.cz + {s}.hz))"
    return f"(CASE WHEN {g} < -{t}.hz - {tol} OR {O.share(t, s)} < {least} THEN 0.0E0 ELSE {O.contact(g, tol)} * {O.share(t, s)} END)"


def _above(t: str, a: str) -> str:
    g, ov = f"(({t}.cz - {t}.hz) - ({a}.cz + {a}.hz))", O.share(t, a)
    h = f"greatest(1.0E0 - {O.ramp(f'greatest(0.0E0, {g})', '0.0E0', '2.5E0')}, 0.15E0)"
    return f"(CASE WHEN {ov} < 0.2E0 OR {g} < -least({t}.hz, {a}.hz) THEN 0.0E0 ELSE {O.gmean([ov, h, O.ramp(f'{t}.cz - {a}.cz', '0.0E0', '0.05E0')], [1, 0.6, 1])} END)"


_simple("rel_on", _support("t", "a", "0.08E0", "0.35E0"), R.on)
_simple("support_score", _support("t", "a", "0.08E0", "0.35E0"), lambda: R.support(T, A, 0.08, 0.35))
_simple("rel_above", _above("t", "a"), R.above)
_simple("rel_below", _above("a", "t"), R.below)
_simple("support_contact", O.contact("((t.cz - t.hz) - (a.cz + a.hz))", "0.08E0"), lambda: R.contact(T.bottom - A.top, 0.08))
_simple("footprint_overlap", O.share("t", "a"), lambda: overlap_share(T, A))
_simple("obb_gap", O.box_gap("t", "a"), lambda: box_gap(T, A))

_GAP = f"greatest(0.0E0, {O.box_gap('t', 'a')})"
_D0 = f"(0.3E0 + 0.3E0 * ({O.reach('t')} + {O.reach('a')}))"
_NEAR = f"(1.0E0 - {O.ramp('g', 'd0', '3 * d0')})"


def _gap_query(key: str, value: str, score) -> None:
    inner = f"SELECT t.scene_id, t.id AS target_id, a.id AS anchor_id, {_GAP} AS g, {_D0} AS d0, abs(t.cz - a.cz) AS dz, sqrt((t.cx - a.cx) * (t.cx - a.cx) + (t.cy - a.cy) * (t.cy - a.cy)) AS flat, {O.lap(O.tall('t'), O.tall('a'))} / (greatest(t.cz + t.hz, a.cz + a.hz) - least(t.cz - t.hz, a.cz - a.hz)) AS ziou, r.diag {O.PAIRS} JOIN (SELECT scene_id, greatest(1.0E0, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (ceiling_z - floor_z) * (ceiling_z - floor_z))) AS diag FROM fx_rooms) r ON r.scene_id = t.scene_id"

    @query(key, f"WITH p AS ({inner}) SELECT scene_id, target_id, anchor_id, {O.r9(value)} AS score FROM p")
    def run(x: Tables) -> DataFrame:
        scale = x.rooms.select("scene_id", frames.room_scale().alias("diag"))
        rows = pairs(x).withColumn("gap", F.greatest(F.lit(0.0), box_gap(T, A)))
        return (rows.join(scale, "scene_id") if key == "rel_far_from" else rows).select(*ids(), r9(score(F.col("gap"))).alias("score"))


_gap_query("rel_near", _NEAR, R.near)
_gap_query("rel_next_to", O.gmean([_NEAR, f"greatest(1.0E0 - {O.ramp('dz', '0.35E0', '1.05E0')}, ziou)", O.ramp("flat / (dz + 1e-6)", "0.6E0", "1.5E0")], [1, 0.7, 0.5]), R.next_to)
_gap_query("rel_far_from", O.ramp("g", "0.15E0 * diag", "0.55E0 * diag"), lambda g: R.far_from(g, F.col("diag")))

_VALUE = {"height": "2 * {p}.hz", "volume": "8 * {p}.hx * {p}.hy * {p}.hz", "footprint": "4 * {p}.hx * {p}.hy"}
for _r, (_m, _s) in R.COMPARED.items():
    _t, _a = _VALUE[_m].format(p="t"), _VALUE[_m].format(p="a")
    _simple(f"rel_{_r}", O.ramp(f"({_t if _s > 0 else _a}) / ({_a if _s > 0 else _t})", "1.0E0", "1.25E0"), lambda r=_r: R.compared(r))

#: Corners of a box, as rows of signs.
_SIGNS = "(VALUES (-1,-1,-1),(-1,-1,1),(-1,1,-1),(-1,1,1),(1,-1,-1),(1,-1,1),(1,1,-1),(1,1,1)) AS s(i,j,k)"


def _within(p: str, b: str, pad: str) -> str:
    """Share of p's corners in b, as a correlated count unrolled over signs."""
    one = []
    for i in (-1, 1):
        for j in (-1, 1):
            for k in (-1, 1):
                dx = f"({p}.cx + ({i}) * {p}.hx * {p}.ux - ({j}) * {p}.hy * {p}.uy - {b}.cx)"
                dy = f"({p}.cy + ({i}) * {p}.hx * {p}.uy + ({j}) * {p}.hy * {p}.ux - {b}.cy)"
                one.append(f"(CASE WHEN abs({dx} * {b}.ux + {dy} * {b}.uy) <= {b}.hx + {pad} AND abs({dy} * {b}.ux - {dx} * {b}.uy) <= {b}.hy + {pad} AND abs({p}.cz + ({k}) * {p}.hz - {b}.cz) <= {b}.hz + {pad} THEN 1 ELSE 0 END)")
    return f"(CAST({' + '.join(one)} AS DOUBLE) / 8)"


_simple("rel_inside", f"(CASE WHEN t.hx * t.hy * t.hz > a.hx * a.hy * a.hz THEN 0.0E0 ELSE {O.ramp(_within('t', 'a', '0.05E0'), '0.3E0', '0.6E0')} END)", R.inside)


@query("rel_encloses", O.pairs(f"CASE WHEN {_support('a', 't', '0.12E0', '0.35E0')} > 0.25E0 THEN 'supports' WHEN t.hx * t.hy * t.hz > 2 * a.hx * a.hy * a.hz AND {_within('a', 't', '0.02E0')} > 0.75E0 THEN 'contains' END AS veto"))
def rel_encloses(x: Tables) -> DataFrame:
    return pairs(x).select(*ids(), R.encloses().alias("veto"))


_ABX, _ABY = "(b.cx - a.cx)", "(b.cy - a.cy)"
_BETWEEN = f"""
WITH q AS (SELECT query_id, scene_id, target, anchor, anchor2 FROM fx_utterances_rich WHERE family = 4),
p AS (SELECT q.query_id, t.id AS target_id, a.id AS anchor_id, b.id AS anchor2_id, sqrt({_ABX} * {_ABX} + {_ABY} * {_ABY}) AS len, {_ABX} AS abx, {_ABY} AS aby, t.cx - a.cx AS dx, t.cy - a.cy AS dy, 0.7E0 + 0.5E0 * ({O.reach('a')} + {O.reach('b')}) AS w
  FROM q JOIN fx_objects t ON t.scene_id = q.scene_id AND t.label = q.target JOIN fx_objects a ON a.scene_id = q.scene_id AND a.label = q.anchor JOIN fx_objects b ON b.scene_id = q.scene_id AND b.label = q.anchor2),
s AS (SELECT *, (dx * abx + dy * aby) / (len * len) AS f FROM p),
v AS (SELECT *, sqrt((dx - f * abx) * (dx - f * abx) + (dy - f * aby) * (dy - f * aby)) AS perp FROM s)
SELECT query_id, target_id, anchor_id, anchor2_id, CASE WHEN len < 1e-3 THEN 0.0E0 ELSE {O.r9(O.gmean([f"least({O.ramp('f', '0.06E0', '0.12E0')}, 1.0E0 - {O.ramp('f', '0.88E0', '1.0E0')})", f"1.0E0 - {O.ramp('perp', '0.5E0 * w', '1.5E0 * w')}"], [1, 0.8]))} END AS score FROM v"""


@query("rel_between", _BETWEEN)
def rel_between(x: Tables) -> DataFrame:
    """Over the phrases that say between: every target with every pair of anchors."""
    q = x.rich.where("family = 4").select("query_id", "scene_id", "target", "anchor", "anchor2")
    t, a, b = (prefixed(x.objects, p, ("scene_id",)) for p in "tab")
    rows = q.join(t.withColumnRenamed("t_label", "target"), ["scene_id", "target"]).join(a.withColumnRenamed("a_label", "anchor"), ["scene_id", "anchor"]).join(b.withColumnRenamed("b_label", "anchor2"), ["scene_id", "anchor2"])
    return rows.select("query_id", F.col("t_id").alias("target_id"), F.col("a_id").alias("anchor_id"), F.col("b_id").alias("anchor2_id"), r9(R.between()).alias("score"))
