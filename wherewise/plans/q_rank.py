"""Queries of ordinals, superlatives, shelf levels, rooms and walls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, clip, prefixed, r9, ramp
from ..operators import ranking, rooms
from . import oracle as O
from .catalog import query
from .fixtures import Tables

# Ordinals: the objects of each class and scene, counted from the left of a viewer at (3, -1) who looks at the room's middle: the frame
# is read at one point, so keys are coordinates along its right axis.
_LINE = """
m AS (SELECT scene_id, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM fx_rooms),
f AS (SELECT scene_id, mx, my, (my + 1) / sqrt((mx - 3) * (mx - 3) + (my + 1) * (my + 1)) AS rx, -(mx - 3) / sqrt((mx - 3) * (mx - 3) + (my + 1) * (my + 1)) AS ry FROM m),
k AS (SELECT o.scene_id, o.label, o.id, round(o.cx * f.rx + o.cy * f.ry, 9) AS key, 2 * (o.hx * abs(o.ux * f.rx + o.uy * f.ry) + o.hy * abs(-o.uy * f.rx + o.ux * f.ry)) AS width FROM fx_objects o JOIN f ON f.scene_id = o.scene_id),
r AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY scene_id, label) AS n, key - lag(key) OVER w AS gap FROM k WINDOW w AS (PARTITION BY scene_id, label ORDER BY key, id))"""


def line(x: Tables) -> DataFrame:
    return ranking.line_up(x.objects, ranking.room_frame(x.rooms, 3.0, -1.0), ["scene_id", "label"])


@query("ord_frame_axis", f"WITH {_LINE} SELECT scene_id, {O.r9('rx')} AS right_x, {O.r9('ry')} AS right_y FROM f")
def ord_frame_axis(x: Tables) -> DataFrame:
    """The counting direction from the left: along the frame's right axis."""
    return ranking.room_frame(x.rooms, 3.0, -1.0).select("scene_id", r9(F.col("rx")).alias("right_x"), r9(F.col("ry")).alias("right_y"))


@query("ord_order", f"WITH {_LINE} SELECT scene_id, label, id, place, {O.r9('key')} AS key FROM r")
def ord_order(x: Tables) -> DataFrame:
    return line(x).select("scene_id", "label", "id", "place", r9(F.col("key")).alias("key"))


@query("ord_apply", f"WITH {_LINE} SELECT scene_id, label, CAST(max(CASE WHEN place = 2 THEN id END) AS BIGINT) AS second_from_left, CAST(max(CASE WHEN place = n - 1 THEN id END) AS BIGINT) AS second_from_right, CAST(max(CASE WHEN place = n THEN id END) AS BIGINT) AS last, max(n) < 9 AS ninth_missing, {O.r9('max(key) - min(key)')} AS spread, {O.r9('min(gap)')} AS min_gap, {O.r9('median(gap)')} AS median_gap, max(key) - min(key) < 1.4E0 * avg(width) AS degenerate, min(gap) < 0.06E0 OR min(gap) < 0.35E0 * median(gap) AS fragile FROM r GROUP BY scene_id, label")
def ord_apply(x: Tables) -> DataFrame:
    """Picks from either end with the flags of an uncertain order."""
    rows = line(x)
    pick = lambda place: F.max(F.when(F.col("place") == place, F.col("id")))
    n = F.col("n")
    return (
        rows.groupBy("scene_id", "label")
        .agg(pick(2).alias("second_from_left"), pick(n - 1).alias("second_from_right"), pick(n).alias("last"), F.max("n").alias("n"), *ranking.order_measures())
        .select("scene_id", "label", "second_from_left", "second_from_right", "last", (F.col("n") < 9).alias("ninth_missing"), *[r9(F.col(c)).alias(c) for c in ("spread", "min_gap", "median_gap")], ranking.degenerate().alias("degenerate"), ranking.fragile().alias("fragile"))
    )


@query("ord_middle", f"WITH {_LINE} SELECT scene_id, label, id FROM r WHERE (n % 2 = 1 AND place = (n + 1) // 2) OR (n % 2 = 0 AND place IN (n // 2, n // 2 + 1))")
def ord_middle(x: Tables) -> DataFrame:
    """The one in the middle, or both of an even number."""
    return line(x).where(ranking.in_middle()).select("scene_id", "label", "id")


@query("amb_level_even", f"WITH {_LINE} SELECT scene_id, label, max(n) % 2 = 0 AS two_in_the_middle FROM r GROUP BY scene_id, label")
def amb_level_even(x: Tables) -> DataFrame:
    return line(x).groupBy("scene_id", "label").agg((F.max("n") % 2 == 0).alias("two_in_the_middle"))


@query("amb_ordinal", f"WITH {_LINE}, a AS (SELECT scene_id, label, max(key) - min(key) < 1.4E0 * avg(width) AS degenerate, min(gap) < 0.06E0 OR min(gap) < 0.35E0 * median(gap) AS fragile FROM r GROUP BY scene_id, label) SELECT scene_id, CAST(count_if(degenerate) AS BIGINT) AS ordinal_degenerate, CAST(count_if(fragile) AS BIGINT) AS ordinal_tie FROM a GROUP BY scene_id")
def amb_ordinal(x: Tables) -> DataFrame:
    a = line(x).groupBy("scene_id", "label").agg(*ranking.order_measures()).select("scene_id", ranking.degenerate().alias("d"), ranking.fragile().alias("f"))
    return a.groupBy("scene_id").agg(F.count_if("d").alias("ordinal_degenerate"), F.count_if("f").alias("ordinal_tie"))


@query("ord_integrate", f"WITH {_LINE} SELECT scene_id, label, id, CASE WHEN place = 2 THEN 1 WHEN place < 2 THEN place + 1 ELSE place END AS rank FROM r WHERE n >= 2")
def ord_integrate(x: Tables) -> DataFrame:
    """The picked one first, the rest in their order."""
    p = F.col("place")
    return line(x).where("n >= 2").select("scene_id", "label", "id", F.when(p == 2, 1).when(p < 2, p + 1).otherwise(p).cast("long").alias("rank"))


@query("ord_landmark_axis", f"WITH l AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY scene_id ORDER BY hx * hy * hz DESC, id) AS q FROM fx_objects o WHERE label = 'gear') g WHERE q = 1), d AS (SELECT o.scene_id, o.label, o.id, sqrt((o.cx - l.cx) * (o.cx - l.cx) + (o.cy - l.cy) * (o.cy - l.cy) + (o.cz - l.cz) * (o.cz - l.cz)) AS key FROM fx_objects o JOIN l ON l.scene_id = o.scene_id WHERE o.label <> 'gear') SELECT scene_id, label, id, {O.r9('key')} AS key, row_number() OVER (PARTITION BY scene_id, label ORDER BY round(key, 9), id) AS place FROM d")
def ord_landmark_axis(x: Tables) -> DataFrame:
    """Counting outwards from the scene's largest gear."""
    return ranking.from_landmark(x.objects, "gear").select("scene_id", "label", "id", r9(F.col("key")).alias("key"), F.col("place").cast("long").alias("place"))


_SUP = "CASE WHEN abs(b.ux * f.rx + b.uy * f.ry) < 0.35E0"


@query("ord_support_axis", f"WITH {_LINE} SELECT b.scene_id, b.id, {O.r9('b.ux * sign(b.ux * f.rx + b.uy * f.ry)')} AS dir_x, {O.r9('b.uy * sign(b.ux * f.rx + b.uy * f.ry)')} AS dir_y, abs(b.ux * f.rx + b.uy * f.ry) < 0.35E0 AS vague FROM fx_objects b JOIN f ON f.scene_id = b.scene_id WHERE abs(b.ux * f.rx + b.uy * f.ry) > 1e-9")
def ord_support_axis(x: Tables) -> DataFrame:
    """A support's long axis, pointed so that counting starts at the named end; vague where it is nearly across."""
    rows = x.objects.join(ranking.room_frame(x.rooms, 3.0, -1.0), "scene_id")
    dot = F.col("ux") * F.col("rx") + F.col("uy") * F.col("ry")
    return rows.where(F.abs(dot) > 1e-9).select("scene_id", "id", r9(F.col("ux") * F.signum(dot)).alias("dir_x"), r9(F.col("uy") * F.signum(dot)).alias("dir_y"), (F.abs(dot) < 0.35).alias("vague"))


@query("ord_axis_choice", "SELECT query_id, CASE WHEN family = 0 THEN 'support' WHEN family IN (1, 2) THEN 'frame' END AS axis FROM fx_utterances_rich WHERE family < 3")
def ord_axis_choice(x: Tables) -> DataFrame:
    """What an ordinal is counted along: a landmark, else a support, else the frame at the room's middle."""
    from ..operators import parsing

    q = parsing.parsed(x.rich.where("family < 3").select("query_id", "text"))
    axis = F.when(F.col("from_landmark").isNotNull(), "landmark").when(F.col("relation").isin("on", "inside", "above"), "support").otherwise("frame")
    return q.select("query_id", axis.alias("axis"))


_VOL = "8 * hx * hy * hz"


@query("superlative_rank", f"WITH r AS (SELECT scene_id, label, id, {_VOL} AS v, row_number() OVER w AS rank, lead({_VOL}) OVER w AS nxt FROM fx_objects WINDOW w AS (PARTITION BY scene_id, label ORDER BY {_VOL} DESC, id)) SELECT scene_id, label, id, rank, CASE WHEN rank = 1 THEN coalesce(v - nxt <= 0.06E0 * greatest(abs(v), 1e-9), FALSE) END AS tie FROM r")
def superlative_rank(x: Tables) -> DataFrame:
    """Biggest first, with a tie where the first two are within 6 %."""
    rows = ranking.by_size(x.objects)
    tie = F.when(F.col("rank") == 1, F.coalesce(F.col("size") - F.col("next") <= 0.06 * F.greatest(F.abs("size"), F.lit(1e-9)), F.lit(False)))
    return rows.select("scene_id", "label", "id", F.col("rank").cast("long").alias("rank"), tie.alias("tie"))


@query("size_apply", f"WITH r AS (SELECT scene_id, label, id, row_number() OVER (PARTITION BY scene_id, label ORDER BY {_VOL} DESC, id) - 1 AS k, count(*) OVER (PARTITION BY scene_id, label) AS n FROM fx_objects) SELECT scene_id, label, id, {O.r9('least(1.0E0, greatest(0.4E0, 1.0E0 - 0.5E0 * k / greatest(n - 1, 1)))')} AS factor FROM r")
def size_apply(x: Tables) -> DataFrame:
    """How much a bare adjective keeps of each candidate's score."""
    rows = ranking.by_size(x.objects)
    return rows.select("scene_id", "label", "id", r9(clip(1.0 - 0.5 * (F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1)), 0.4)).alias("factor"))


_GAP = f"greatest(0.0E0, {O.box_gap('t', 'a')})"


@query(
    "proximity_rank",
    f"WITH a AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY scene_id, label ORDER BY hx * hy * hz DESC, id) AS q FROM fx_objects o) z WHERE q <= 6), g AS (SELECT u.query_id, t.id, min({_GAP}) AS gap FROM fx_utterances u JOIN a ON a.scene_id = u.scene_id AND a.label = u.anchor JOIN fx_objects t ON t.scene_id = u.scene_id AND t.label = u.target AND t.id <> a.id WHERE u.relation = 'near' GROUP BY u.query_id, t.id), "
    f"l AS (SELECT *, min(gap) OVER (PARTITION BY query_id) AS lo FROM g) SELECT query_id, id, {O.r9('CASE WHEN gap <= lo + 1e-9 THEN 1.0E0 ELSE least(1.0E0, (lo + 0.05E0) / (gap + 0.05E0)) END')} AS score FROM l",
)
def proximity_rank(x: Tables) -> DataFrame:
    """Near phrases read as "nearest": candidates by the ratio to the smallest gap, so there is always a winner."""
    return ranking.nearest(x.utterances.where("relation = 'near'"), x.objects).select("query_id", "id", r9(F.col("score")).alias("score"))


# levels: heights of tops of small things on big ones make shelves -----------------------------------------------------------------

_LEVELS = "SELECT scene_id, z, count(*) AS n, row_number() OVER (PARTITION BY scene_id ORDER BY z) - 1 AS idx, count(*) OVER (PARTITION BY scene_id) AS levels FROM (SELECT scene_id, round((cz + hz) * 4) / 4 AS z FROM fx_objects) q GROUP BY scene_id, z HAVING count(*) >= 5"


@query("levels_shelf", f"WITH l AS ({_LEVELS}) SELECT scene_id, idx, {O.r9('z')} AS z FROM l WHERE levels >= 3 AND idx < levels - 1")
def levels_shelf(x: Tables) -> DataFrame:
    """Levels from the bottom, without the topmost; none if fewer than two are left."""
    return rooms.levels(x.objects).where("levels >= 3 and idx < levels - 1").select("scene_id", F.col("idx").cast("long").alias("idx"), r9(F.col("z")).alias("z"))


@query("level_middle_ordinal", f"WITH l AS ({_LEVELS}) SELECT scene_id, idx, levels % 2 = 0 AS even FROM l WHERE (levels % 2 = 1 AND idx = levels // 2) OR (levels % 2 = 0 AND idx IN (levels // 2 - 1, levels // 2))")
def level_middle_ordinal(x: Tables) -> DataFrame:
    n, i = F.col("levels"), F.col("idx")
    half = F.floor(n / 2)
    return rooms.levels(x.objects).where(F.when(n % 2 == 1, i == half).otherwise((i == half - 1) | (i == half))).select("scene_id", i.cast("long").alias("idx"), (n % 2 == 0).alias("even"))


@query("level_assign", f"WITH l AS ({_LEVELS}) SELECT scene_id, id, idx FROM (SELECT o.scene_id, o.id, l.idx, row_number() OVER (PARTITION BY o.scene_id, o.id ORDER BY round(abs(o.cz - o.hz - l.z), 9), l.idx) AS q FROM fx_objects o JOIN l ON l.scene_id = o.scene_id AND abs(o.cz - o.hz - l.z) <= 0.08E0) a WHERE q = 1")
def level_assign(x: Tables) -> DataFrame:
    """The level that an object stands on: the nearest to its bottom within 8 cm."""
    l = rooms.levels(x.objects).select("scene_id", "idx", "z")
    o = x.objects.select("scene_id", "id", (F.col("cz") - F.col("hz")).alias("bottom"))
    d = F.abs(F.col("bottom") - F.col("z"))
    near = o.join(l, "scene_id").where(d <= 0.08)
    return near.groupBy("scene_id", "id").agg(F.min_by("idx", F.struct(F.round(d, 9).alias("d"), "idx")).cast("long").alias("idx"))


@query("levels_per_object", f"WITH l AS ({_LEVELS}) SELECT o.scene_id, o.id, count(*) AS levels_below_top FROM fx_objects o JOIN l ON l.scene_id = o.scene_id AND l.z < o.cz + o.hz GROUP BY o.scene_id, o.id")
def levels_per_object(x: Tables) -> DataFrame:
    l = rooms.levels(x.objects).select("scene_id", "z")
    return x.objects.join(l, "scene_id").where(F.col("z") < F.col("cz") + F.col("hz")).groupBy("scene_id", "id").agg(F.count("*").alias("levels_below_top"))


@query("levels_detect", None)
def levels_detect(x: Tables) -> DataFrame:
    """Peaks of each object's heights, greedily from the highest count, at least 12 cm apart."""
    return rooms.detect_levels(x.points)


# rooms ----------------------------------------------------------------------------------------------------------------------------


@query("room_manhattan", f"SELECT scene_id, {O.r9('atan2(sum(w * sin(4 * t)), sum(w * cos(4 * t))) / 4')} AS axis, {O.r9('sqrt(sum(w * cos(4 * t)) * sum(w * cos(4 * t)) + sum(w * sin(4 * t)) * sum(w * sin(4 * t))) / sum(w)')} AS resultant FROM (SELECT scene_id, atan2(uy, ux) AS t, 4 * (hx + hy) * hz AS w FROM fx_objects) a GROUP BY scene_id")
def room_manhattan(x: Tables) -> DataFrame:
    """The common direction of walls: circular mean of four times the angle, weighted by area."""
    return rooms.manhattan(x.objects).select("scene_id", r9(F.col("axis")).alias("axis"), r9(F.col("resultant")).alias("resultant"))


_WALL = "SELECT p.scene_id, d.k, p.x * d.dx + p.y * d.dy AS s, p.x * d.dy - p.y * d.dx AS a, p.z FROM fx_points p CROSS JOIN (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) AS d(k, dx, dy)"


@query("room_walls", f"WITH w AS ({_WALL}), q AS (SELECT scene_id, k, quantile_cont(s, 0.995) AS edge FROM w GROUP BY scene_id, k) SELECT w.scene_id, w.k AS side, {O.r9('max(q.edge)')} AS edge, count(*) AS support, {O.r9('CAST(count(DISTINCT (floor(w.a / 0.1E0), floor(w.z / 0.1E0))) AS DOUBLE) * 0.01E0')} AS area FROM w JOIN q ON q.scene_id = w.scene_id AND q.k = w.k WHERE abs(w.s - q.edge) <= 0.25E0 GROUP BY w.scene_id, w.k")
def room_walls(x: Tables) -> DataFrame:
    """The outermost slab on each side, and the cells that its points occupy."""
    return rooms.walls(x.points).select("scene_id", "side", r9(F.col("edge")).alias("edge"), "support", r9(F.col("area")).alias("area"))


@query("room_build", f"SELECT scene_id, {O.r9('quantile_cont(z, 0.002)')} AS floor_z, {O.r9('CASE WHEN quantile_cont(z, 0.998) >= 1.2E0 THEN quantile_cont(z, 0.998) END')} AS ceiling_z, {O.r9('quantile_cont(x, 0.001)')} AS x0, {O.r9('quantile_cont(x, 0.999)')} AS x1, {O.r9('quantile_cont(y, 0.001)')} AS y0, {O.r9('quantile_cont(y, 0.999)')} AS y1 FROM fx_points GROUP BY scene_id")
def room_build(x: Tables) -> DataFrame:
    return rooms.bounds(x.points)


@query("room_forward", f"WITH w AS ({_WALL}), q AS (SELECT scene_id, k, quantile_cont(s, 0.995) AS edge FROM w GROUP BY scene_id, k), a AS (SELECT w.scene_id, w.k, CAST(count(DISTINCT (floor(w.a / 0.1E0), floor(w.z / 0.1E0))) AS DOUBLE) * 0.01E0 AS area FROM w JOIN q ON q.scene_id = w.scene_id AND q.k = w.k WHERE abs(w.s - q.edge) <= 0.25E0 GROUP BY w.scene_id, w.k), h AS (SELECT scene_id, avg(fwd_x) AS hx, avg(fwd_y) AS hy FROM fx_poses GROUP BY scene_id), s AS (SELECT a.scene_id, a.k, 0.6E0 * a.area / max(a.area) OVER (PARTITION BY a.scene_id) + 0.4E0 * greatest(0.0E0, CASE a.k WHEN 0 THEN hx WHEN 1 THEN -hx WHEN 2 THEN hy ELSE -hy END) AS score FROM a JOIN h ON h.scene_id = a.scene_id) SELECT scene_id, {O.r9('max(score)')} AS best, {O.r9('least(1.0E0, max(score) - min(CASE WHEN n = 2 THEN score END))')} AS margin FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, k) AS n FROM s) r GROUP BY scene_id")
def room_forward(x: Tables) -> DataFrame:
    """The room's forward side: area of the wall and the camera's mean heading; the margin to the second best."""
    return rooms.forward(x.points, x.poses).select("scene_id", r9(F.col("best")).alias("best"), r9(F.col("margin")).alias("margin"))


@query("room_up", None)
def room_up(x: Tables) -> DataFrame:
    """Tilt of each scene's dominant plane against the vertical, as a correction of at most 10 degrees."""
    from ..operators import clouds

    n = clouds.planes(x.points)
    tilt = F.degrees(F.acos(F.least(F.lit(1.0), F.abs("nz"))))
    return n.select("scene_id", tilt.alias("tilt_deg"), (tilt <= 10).alias("ok"))
