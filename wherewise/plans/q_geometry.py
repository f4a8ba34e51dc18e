"""Queries of the geometry kernel, frames, viewpoints and poses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, Span, box_gap, contains, corners, horizontal, prefixed, r9
from ..operators import clouds, frames, poses
from . import oracle as O
from .catalog import query
from .fixtures import Tables

OBJ = "FROM fx_objects o"
_ID = "SELECT scene_id, id, "


def _r(**columns: str) -> str:
    return ", ".join(f"{O.r9(v)} AS {k}" for k, v in columns.items())


def _cols(**columns) -> list:
    return [r9(v).alias(k) for k, v in columns.items()]


def boxes(x: Tables) -> DataFrame:
    return prefixed(x.objects, "t", ("scene_id",))


def _per_object(key: str, sql: dict[str, str], columns) -> None:
    @query(key, f"{_ID}{_r(**sql)} {OBJ}")
    def run(x: Tables) -> DataFrame:
        return boxes(x).select("scene_id", F.col("t_id").alias("id"), *_cols(**columns(Box("t"))))


_N = "sqrt(cx * cx + cy * cy + cz * cz)"
_per_object("vec_normalize", {"x": f"cx / {_N}", "y": f"cy / {_N}", "z": f"cz / {_N}"}, lambda t: {k: v / F.sqrt(t.cx * t.cx + t.cy * t.cy + t.cz * t.cz) for k, v in (("x", t.cx), ("y", t.cy), ("z", t.cz))})
_H = "sqrt(cx * cx + cy * cy)"
_per_object("vec_horizontal", {"x": f"CASE WHEN {_H} < 1e-6 THEN 0.0E0 ELSE cx / {_H} END", "y": f"CASE WHEN {_H} < 1e-6 THEN 0.0E0 ELSE cy / {_H} END"}, lambda t: dict(zip("xy", horizontal(t.cx, t.cy), strict=True)))
_TH = "radians(CAST(id AS DOUBLE))"
_per_object(
    "rot_axis_angle",
    {"x": f"cx * cos({_TH}) - cy * sin({_TH})", "y": f"cx * sin({_TH}) + cy * cos({_TH})", "z": "cz"},
    lambda t: {"x": t.cx * F.cos(F.radians(t.id)) - t.cy * F.sin(F.radians(t.id)), "y": t.cx * F.sin(F.radians(t.id)) + t.cy * F.cos(F.radians(t.id)), "z": t.cz},
)
_per_object("basis_forward_up", {"right_x": "uy", "right_y": "-ux", "det": "uy * uy + ux * ux"}, lambda t: {"right_x": t.uy, "right_y": -t.ux, "det": t.uy * t.uy + t.ux * t.ux})
_per_object(
    "se3_ops",
    {"local_x": "(3 - cx) * ux + (2 - cy) * uy", "local_y": "(2 - cy) * ux - (3 - cx) * uy", "local_z": "1 - cz", "back_x": "3.0E0", "back_y": "2.0E0"},
    lambda t: (lambda lx, ly: {"local_x": lx, "local_y": ly, "local_z": 1.0 - t.cz, "back_x": t.cx + lx * t.ux - ly * t.uy, "back_y": t.cy + lx * t.uy + ly * t.ux})((3.0 - t.cx) * t.ux + (2.0 - t.cy) * t.uy, (2.0 - t.cy) * t.ux - (3.0 - t.cx) * t.uy),
)
_per_object(
    "obb_measures",
    {"volume": "8 * hx * hy * hz", "footprint": "4 * hx * hy", "height": "2 * hz", "top": "cz + hz", "bottom": "cz - hz", "reach": "sqrt(hx * hx + hy * hy)", "yaw": "atan2(uy, ux)", "max_dim": "2 * greatest(hx, hy, hz)", "diameter": "2 * sqrt(hx * hx + hy * hy + hz * hz)"},
    lambda t: {"volume": t.volume, "footprint": t.footprint, "height": t.height, "top": t.top, "bottom": t.bottom, "reach": t.reach, "yaw": F.atan2(t.uy, t.ux), "max_dim": 2.0 * F.greatest(t.hx, t.hy, t.hz), "diameter": 2.0 * F.sqrt(t.hx * t.hx + t.hy * t.hy + t.hz * t.hz)},
)
_per_object("size_metrics", {"height": "2 * hz", "volume": "8 * hx * hy * hz", "footprint": "4 * hx * hy", "width": "2 * hx", "length": "2 * hx"}, lambda t: {"height": t.height, "volume": t.volume, "footprint": t.footprint, "width": 2.0 * F.greatest(t.hx, t.hy), "length": 2.0 * F.greatest(t.hx, t.hy)})
_per_object("obb_interval", {"lo": "cx - hx * abs(ux) - hy * abs(uy)", "hi": "cx + hx * abs(ux) + hy * abs(uy)"}, lambda t: (lambda s: {"lo": s.lo, "hi": s.hi})(t.span(F.lit(1.0), F.lit(0.0))))
_per_object(
    "obb_transform",
    {"cx2": "-cy + 1", "cy2": "cx + 2", "ux2": "-uy", "uy2": "ux", "ax": "hx * abs(uy) + hy * abs(ux)", "ay": "hx * abs(ux) + hy * abs(uy)"},
    lambda t: {"cx2": -t.cy + 1.0, "cy2": t.cx + 2.0, "ux2": -t.uy, "uy2": t.ux, "ax": t.hx * F.abs(t.uy) + t.hy * F.abs(t.ux), "ay": t.hx * F.abs(t.ux) + t.hy * F.abs(t.uy)},
)
_per_object(
    "viz_project_box",
    {"corners_ahead": "CAST(" + " + ".join(f"CASE WHEN cx + ({i}) * hx * ux - ({j}) * hy * uy > 3 THEN 1 ELSE 0 END" for i in (-1, 1) for j in (-1, 1)) + " AS DOUBLE) * 2"},
    lambda t: {"corners_ahead": sum((F.when(c[0] > 3.0, 1.0).otherwise(0.0) for c in corners(t)), F.lit(0.0))},
)


@query("interval_algebra", f"SELECT a.scene_id, a.id, {_r(length='a.h - a.l', mid='(a.l + a.h) / 2', overlap='greatest(0.0E0, least(a.h, b.h) - greatest(a.l, b.l))', iou='greatest(0.0E0, least(a.h, b.h) - greatest(a.l, b.l)) / (greatest(a.h, b.h) - least(a.l, b.l))', inside='greatest(0.0E0, least(a.h, b.h) - greatest(a.l, b.l)) / (a.h - a.l)', gap='greatest(b.l - a.h, a.l - b.h, -greatest(0.0E0, least(a.h, b.h) - greatest(a.l, b.l)))', beyond='greatest(0.0E0, a.h - greatest(a.l, b.l)) / (a.h - a.l)')} FROM (SELECT scene_id, id, cx - hx AS l, cx + hx AS h FROM fx_objects) a JOIN (SELECT scene_id, id - 1 AS id, cx - hx AS l, cx + hx AS h FROM fx_objects) b ON a.scene_id = b.scene_id AND a.id = b.id")
def interval_algebra(x: Tables) -> DataFrame:
    t, a = boxes(x), prefixed(x.objects, "a", ("scene_id",))
    one, two = Span(F.col("t_cx") - F.col("t_hx"), F.col("t_cx") + F.col("t_hx")), Span(F.col("a_cx") - F.col("a_hx"), F.col("a_cx") + F.col("a_hx"))
    rows = t.join(a, (t["scene_id"] == a["scene_id"]) & (F.col("t_id") == F.col("a_id") - 1))
    return rows.select(t["scene_id"], F.col("t_id").alias("id"), *_cols(length=one.length, mid=one.mid, overlap=one.overlap(two), iou=one.iou(two), inside=one.inside(two), gap=one.gap(two), beyond=one.beyond(two.lo, 1)))


_INSIDE = "abs((p.x - o.cx) * o.ux + (p.y - o.cy) * o.uy) <= o.hx + 0.05E0 AND abs((p.y - o.cy) * o.ux - (p.x - o.cx) * o.uy) <= o.hy + 0.05E0 AND abs(p.z - o.cz) <= o.hz + 0.05E0"


@query("obb_corners_contains", f"SELECT o.scene_id, o.id, count(*) AS points_inside FROM fx_objects o JOIN fx_points p ON p.scene_id = o.scene_id AND {_INSIDE} GROUP BY o.scene_id, o.id")
def obb_corners_contains(x: Tables) -> DataFrame:
    """Points of any object of the scene inside each padded box."""
    rows = boxes(x).join(x.points.drop("id"), "scene_id").where(contains(Box("t"), F.col("x"), F.col("y"), F.col("z"), 0.05))
    return rows.groupBy("scene_id", F.col("t_id").alias("id")).agg(F.count("*").alias("points_inside"))


@query("camera_project", f"SELECT o.scene_id, o.id, z > 1e-6 AS valid, {_r(u='CASE WHEN z > 1e-6 THEN 320 + 500 * u / z END', v='CASE WHEN z > 1e-6 THEN 240 - 500 * h / z END', depth='z')} FROM (SELECT o.scene_id, o.id, (o.cx - p.ex) * p.fwd_x + (o.cy - p.ey) * p.fwd_y AS z, (o.cx - p.ex) * p.fwd_y - (o.cy - p.ey) * p.fwd_x AS u, o.cz - p.ez AS h FROM fx_objects o JOIN fx_poses p ON p.scene_id = o.scene_id AND p.idx = o.id) o")
def camera_project(x: Tables) -> DataFrame:
    """Each object's centre in the picture of the pose of its number."""
    rows = x.objects.join(x.poses.withColumnRenamed("idx", "id"), ["scene_id", "id"])
    u, v, depth = poses.project(F.col("cx"), F.col("cy"), F.col("cz"))
    return rows.select("scene_id", "id", (depth > 1e-6).alias("valid"), *_cols(u=u, v=v, depth=depth))


@query("cloud_gap", f"SELECT scene_id, id, {_r(least='min(d)', quantile='quantile_cont(d, 0.02)')} FROM (SELECT a.scene_id, a.id, a.pt_idx, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS d FROM fx_points a JOIN fx_points b ON a.scene_id = b.scene_id AND b.id = a.id + 1 GROUP BY a.scene_id, a.id, a.pt_idx) n GROUP BY scene_id, id")
def cloud_gap(x: Tables) -> DataFrame:
    """Least and 2 % quantile of nearest distances between the clouds of objects that follow each other."""
    return clouds.gaps(x.points, x.points.withColumn("id", F.col("id") - 1)).select("scene_id", "id", *_cols(least=F.col("least"), quantile=F.col("quantile")))


@query("voxel_downsample", f"SELECT scene_id, CAST(floor(x / 0.5E0) AS BIGINT) AS i, CAST(floor(y / 0.5E0) AS BIGINT) AS j, CAST(floor(z / 0.5E0) AS BIGINT) AS k, count(*) AS n, {_r(mx='avg(x)', my='avg(y)', mz='avg(z)')} FROM fx_points GROUP BY 1, 2, 3, 4")
def voxel_downsample(x: Tables) -> DataFrame:
    cell = [F.floor(F.col(c) / 0.5).alias(n) for c, n in zip("xyz", "ijk", strict=True)]
    return x.points.groupBy("scene_id", *cell).agg(F.count("*").alias("n"), *[r9(F.avg(c)).alias(f"m{c}") for c in "xyz"])


@query("area_2d", f"SELECT scene_id, {_r(area='CAST(count(*) AS DOUBLE) * 0.0625E0')} FROM (SELECT DISTINCT scene_id, floor(x / 0.25E0) AS i, floor(y / 0.25E0) AS j FROM fx_points) c GROUP BY scene_id")
def area_2d(x: Tables) -> DataFrame:
    """Floor area as occupied cells."""
    cells = x.points.select("scene_id", F.floor(F.col("x") / 0.25).alias("i"), F.floor(F.col("y") / 0.25).alias("j")).distinct()
    return cells.groupBy("scene_id").agg(r9(F.count("*") * 0.0625).alias("area"))


_AABB = ", ".join(f"min({c}) AS {c}0, max({c}) AS {c}1" for c in "xyz")


@query("obb_aabb", f"SELECT scene_id, id, {_r(**{f'{c}{e}': f'{f}({c})' for c in 'xyz' for e, f in ((0, 'min'), (1, 'max'))})} FROM fx_points GROUP BY scene_id, id")
def obb_aabb(x: Tables) -> DataFrame:
    return x.points.groupBy("scene_id", "id").agg(*[r9(f(c)).alias(f"{c}{e}") for c in "xyz" for e, f in ((0, F.min), (1, F.max))])


@query("obb_fit", None)
def obb_fit(x: Tables) -> DataFrame:
    """Smallest upright rectangle around each object's points."""
    return clouds.fit_boxes(x.points)


@query("dbscan", None)
def dbscan(x: Tables) -> DataFrame:
    return clouds.dbscan(x.points, eps=0.6, least=4)


@query("plane_ransac", None)
def plane_ransac(x: Tables) -> DataFrame:
    return clouds.planes(x.points)


@query("normals_pca", None)
def normals_pca(x: Tables) -> DataFrame:
    return clouds.normals(x.points, 8)


# faces of a box by corner number, as in the table of points
_FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


@query(
    "normals_mesh",
    f"WITH t AS (SELECT a.scene_id, a.id, f.i AS face, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz FROM (VALUES {', '.join(f'({i},{p},{q},{r})' for i, (p, q, r) in enumerate(_FACES))}) AS f(i, p, q, r) JOIN fx_points a ON a.pt_idx = f.p JOIN fx_points b ON b.scene_id = a.scene_id AND b.id = a.id AND b.pt_idx = f.q JOIN fx_points c ON c.scene_id = a.scene_id AND c.id = a.id AND c.pt_idx = f.r) "
    f"SELECT scene_id, id, round(sum(0.5E0 * sqrt(nx * nx + ny * ny + nz * nz)), 9) AS area, {_r(nx='sum(abs(nx))', ny='sum(abs(ny))', nz='sum(abs(nz))')} FROM t GROUP BY scene_id, id",
)
def normals_mesh(x: Tables) -> DataFrame:
    """Triangle normals of each box's faces, summed by object."""
    faces = x.spark.createDataFrame([(i, *f) for i, f in enumerate(_FACES)], "face int, p long, q long, r long")
    return clouds.mesh_normals(x.points, F.broadcast(faces)).groupBy("scene_id", "id").agg(F.round(F.sum(0.5 * F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)), 9).alias("area"), *[r9(F.sum(F.abs(F.col(c)))).alias(c) for c in ("nx", "ny", "nz")])


# poses and viewpoints -------------------------------------------------------------------------------------------------------------

_D = "sqrt((o.cx - p.ex) * (o.cx - p.ex) + (o.cy - p.ey) * (o.cy - p.ey) + (o.cz - p.ez) * (o.cz - p.ez))"


@query("pose_nearest", f"SELECT scene_id, id, idx FROM (SELECT o.scene_id, o.id, p.idx, row_number() OVER (PARTITION BY o.scene_id, o.id ORDER BY round({_D}, 9), p.idx) AS n FROM fx_objects o JOIN fx_poses p ON p.scene_id = o.scene_id) r WHERE n = 1")
def pose_nearest(x: Tables) -> DataFrame:
    """For each object the pose that is closest to it: an arg-min over the scene's poses."""
    return poses.nearest(x.objects, x.poses)


_RAD = "sqrt(3 * 0.05E0 * 0.05E0)"
_AX = "(((o.cx - p.ex) * p.fwd_x + (o.cy - p.ey) * p.fwd_y) / d)"


@query(
    "pose_best_view",
    f"WITH c AS (SELECT o.scene_id, o.id, p.idx, {_D} AS d, (o.cx - p.ex) * p.fwd_x + (o.cy - p.ey) * p.fwd_y AS dot FROM fx_objects o JOIN fx_poses p ON p.scene_id = o.scene_id), "
    f"s AS (SELECT *, (dot / d) * exp(-0.5E0 * (ln(d / greatest({_RAD} / 0.18E0, 0.5E0)) / 0.55E0) * (ln(d / greatest({_RAD} / 0.18E0, 0.5E0)) / 0.55E0)) AS score FROM c WHERE d >= 1.25E0 * {_RAD} AND dot / d > 0.25E0) "
    "SELECT scene_id, id, idx FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, id ORDER BY round(score, 9) DESC, idx) AS n FROM s) r WHERE n = 1",
)
def pose_best_view(x: Tables) -> DataFrame:
    """The pose that shows an object's centre most squarely, at a fitting distance."""
    return poses.best_view(x.objects, x.poses)


@query("pose_mean_heading", f"SELECT scene_id, {_r(hx='avg(fwd_x)', hy='avg(fwd_y)', concentration='sqrt(avg(fwd_x) * avg(fwd_x) + avg(fwd_y) * avg(fwd_y))', ex='avg(ex)', ey='avg(ey)')} FROM fx_poses GROUP BY scene_id")
def pose_mean_heading(x: Tables) -> DataFrame:
    h = x.poses.groupBy("scene_id").agg(*[F.avg(c).alias(c) for c in ("fwd_x", "fwd_y", "ex", "ey")])
    return h.select("scene_id", *_cols(hx=F.col("fwd_x"), hy=F.col("fwd_y"), concentration=F.sqrt(F.col("fwd_x") ** 2 + F.col("fwd_y") ** 2), ex=F.col("ex"), ey=F.col("ey")))


@query(
    "viewpoint_resolve",
    f"WITH l AS (SELECT o.scene_id, o.cx, o.cy, row_number() OVER (PARTITION BY scene_id ORDER BY hx * hy * hz DESC, id) AS n FROM fx_objects o WHERE label = 'gear'), "
    f"j AS (SELECT a.scene_id, a.id, l.cx AS lx, l.cy AS ly, a.cx - l.cx AS ix, a.cy - l.cy AS iy, r.floor_z FROM fx_objects a JOIN l ON l.scene_id = a.scene_id AND l.n = 1 JOIN fx_rooms r ON r.scene_id = a.scene_id) "
    f"SELECT scene_id, id, {_r(ex='lx + CASE WHEN sqrt(ix * ix + iy * iy) < 1e-6 THEN 0 ELSE 0.25E0 * ix / sqrt(ix * ix + iy * iy) END', ey='ly + CASE WHEN sqrt(ix * ix + iy * iy) < 1e-6 THEN 0 ELSE 0.25E0 * iy / sqrt(ix * ix + iy * iy) END', ez='floor_z + 1.55E0')} FROM j",
)
def viewpoint_resolve(x: Tables) -> DataFrame:
    """A viewer at the scene's largest gear, looking at each object."""
    size = F.struct((F.col("hx") * F.col("hy") * F.col("hz")).alias("v"), (-F.col("id")).alias("o"))
    mark = x.objects.where("label = 'gear'").groupBy("scene_id").agg(F.max_by(F.struct("cx", "cy"), size).alias("l"))
    rows = x.objects.join(mark, "scene_id").join(x.rooms.select("scene_id", "floor_z"), "scene_id")
    ex, ey, ez = frames.landmark_eye(F.col("l.cx"), F.col("l.cy"), F.col("floor_z"), F.col("cx"), F.col("cy"))
    return rows.select("scene_id", "id", *_cols(ex=ex, ey=ey, ez=ez))


# frames ---------------------------------------------------------------------------------------------------------------------------

_FR = "(SELECT o.*, r.forward_margin, r.axis_confidence, (o.cx - 3) / sqrt((o.cx - 3) * (o.cx - 3) + (o.cy + 1) * (o.cy + 1)) AS lx, (o.cy + 1) / sqrt((o.cx - 3) * (o.cx - 3) + (o.cy + 1) * (o.cy + 1)) AS ly FROM fx_objects o JOIN fx_rooms r ON r.scene_id = o.scene_id) o"
_KIND_SQL = {
    "egocentric": ("ly", "-lx", "-lx", "-ly", "1.0E0", "TRUE"),
    "egocentric_bearing": ("ly", "-lx", "-lx", "-ly", "1.0E0", "TRUE"),
    "egocentric_image": ("NULL::DOUBLE", "NULL::DOUBLE", "NULL::DOUBLE", "NULL::DOUBLE", "0.0E0", "FALSE"),
    "intrinsic": ("front_y", "-front_x", "front_x", "front_y", "CASE WHEN front_x IS NULL THEN 0.0E0 ELSE front_confidence END", "front_x IS NOT NULL"),
    "addressee": ("-front_y", "front_x", "front_x", "front_y", "CASE WHEN front_x IS NULL THEN 0.0E0 ELSE front_confidence END", "front_x IS NOT NULL"),
    "world": ("1.0E0", "0.0E0", "0.0E0", "1.0E0", "least(1.0E0, greatest(0.0E0, least(forward_margin / 0.3E0, axis_confidence)))", "TRUE"),
}


def _kind(k: str) -> str:
    rx, ry, fx, fy, c, a = _KIND_SQL[k]
    return f"SELECT scene_id, id, '{k}' AS kind, {_r(rx=rx, ry=ry, fx=fx, fy=fy, confidence=c)}, {a} AS available FROM {_FR}"


def all_frames(x: Tables) -> DataFrame:
    a = prefixed(x.objects, "a", ("scene_id",)).join(x.rooms.select("scene_id", "forward_margin", "axis_confidence"), "scene_id")
    return frames.with_axes(a, F.lit(3.0), F.lit(-1.0))


def _frame_rows(x: Tables) -> DataFrame:
    return all_frames(x).select("scene_id", F.col("a_id").alias("id"), "kind", *[r9(F.col(c)).alias(c) for c in ("rx", "ry", "fx", "fy", "confidence")], "available")


@query("frames_build", " UNION ALL ".join(_kind(k) for k in _KIND_SQL))
def frames_build(x: Tables) -> DataFrame:
    return _frame_rows(x)


for _k in _KIND_SQL:

    @query(f"frame_{_k.removeprefix('egocentric_')}", _kind(_k))
    def _one(x: Tables, k: str = _k) -> DataFrame:
        return _frame_rows(x).where(F.col("kind") == k)


@query("frame_ops", f"SELECT scene_id, id, kind, {_r(handedness='sign(rx * fy - ry * fx)')} FROM ({' UNION ALL '.join(_kind(k) for k in _KIND_SQL)}) k WHERE available")
def frame_ops(x: Tables) -> DataFrame:
    """Right- or left-handed: the sign of the axes' determinant."""
    return all_frames(x).where("available").select("scene_id", F.col("a_id").alias("id"), "kind", r9(F.signum(F.col("rx") * F.col("fy") - F.col("ry") * F.col("fx"))).alias("handedness"))


_RHO = "greatest(1e-3, sqrt((a.cx - 3) * (a.cx - 3) + (a.cy + 1) * (a.cy + 1)))"


@query(
    "frame_bearing_coords",
    f"SELECT t.scene_id, t.id AS target_id, a.id AS anchor_id, {_r(lateral=f'{_RHO} * atan2((t.cx - 3) * (a.cy + 1) / {_RHO} - (t.cy + 1) * (a.cx - 3) / {_RHO}, (t.cx - 3) * (a.cx - 3) / {_RHO} + (t.cy + 1) * (a.cy + 1) / {_RHO})', frontal=f'{_RHO} - sqrt((t.cx - 3) * (t.cx - 3) + (t.cy + 1) * (t.cy + 1))')} {O.PAIRS}",
)
def frame_bearing_coords(x: Tables) -> DataFrame:
    """Coordinates by bearing: arc to the side and difference of range."""
    t, a = boxes(x), prefixed(x.objects, "a", ("scene_id",))
    rows = t.join(a, "scene_id").where("t_id <> a_id")
    lx, ly = horizontal(F.col("a_cx") - 3.0, F.col("a_cy") + 1.0)
    rho = F.greatest(F.lit(1e-3), F.sqrt((F.col("a_cx") - 3.0) ** 2 + (F.col("a_cy") + 1.0) ** 2))
    dx, dy = F.col("t_cx") - 3.0, F.col("t_cy") + 1.0
    return rows.select("scene_id", F.col("t_id").alias("target_id"), F.col("a_id").alias("anchor_id"), *_cols(lateral=rho * F.atan2(dx * ly - dy * lx, dx * lx + dy * ly), frontal=rho - F.sqrt(dx * dx + dy * dy)))


_PRI = {"front_back": {"intrinsic": 1.0, "egocentric": 0.55, "addressee": 0.25, "world": 0.15}, "left_right": {"egocentric": 1.0, "intrinsic": 0.55, "addressee": 0.35, "world": 0.15}}
_DECIDE = f"""
WITH k AS ({' UNION ALL '.join(f"SELECT scene_id, id, front_confidence, '{k}' AS kind, ({_KIND_SQL[k][4]}) AS confidence, {_KIND_SQL[k][5]} AS available FROM {_FR}" for k in ('egocentric', 'intrinsic', 'addressee', 'world'))}),
p AS (SELECT k.*, g.grp, g.pos, CASE WHEN k.kind IN ('intrinsic', 'addressee') AND front_confidence < 0.25E0 THEN g.prior * 0.35E0 ELSE g.prior END AS prior FROM k JOIN (VALUES {', '.join(f"('{g}', '{kk}', {i}, CAST({v} AS DOUBLE))" for g, t in _PRI.items() for i, (kk, v) in enumerate(t.items()))}) AS g(grp, kind, pos, prior) ON g.kind = k.kind)
SELECT scene_id, id, grp, kind FROM (SELECT p.*, row_number() OVER (PARTITION BY scene_id, id, grp ORDER BY prior DESC, pos) AS n FROM p WHERE available AND confidence >= 0.15E0) c WHERE n = 1"""


def decided(x: Tables) -> DataFrame:
    groups = F.explode(F.array(*[F.lit(g) for g in frames.PRIORS]))
    rows = all_frames(x).where(F.col("kind").isin("egocentric", "intrinsic", "addressee", "world")).withColumn("grp", groups)
    prior = frames.prior_of(F.col("kind"), F.col("grp"), F.coalesce("a_front_confidence", F.lit(0.0)), F.lit(False), F.lit(None).cast("double"))
    return rows.withColumns({"prior": prior, "pos": frames.position(F.col("kind"), F.col("grp"))})


@query("frame_decide", _DECIDE)
def frame_decide(x: Tables) -> DataFrame:
    """The frame that the policy takes for each object and group of relations, when the sentence says nothing."""
    top = F.max_by("kind", F.struct("prior", (-F.col("pos")).alias("o"))).alias("kind")
    return decided(x).where(frames.usable(F.lit(False))).groupBy("scene_id", F.col("a_id").alias("id"), "grp").agg(top)


_WHY = {("front_back", "intrinsic"): "'in front of' means the side the anchor faces", ("front_back", "egocentric"): "'in front of' means the side nearer the viewer", ("left_right", "egocentric"): "the speaker's left", ("left_right", "intrinsic"): "the anchor's own left"}


@query("frame_rationale", f"SELECT d.scene_id, d.id, d.grp, coalesce(w.why, 'another reading') AS why FROM ({_DECIDE}) d LEFT JOIN (VALUES {', '.join(f"""('{g}', '{k}', '{t.replace("'", "''")}')""" for (g, k), t in _WHY.items())}) AS w(grp, kind, why) ON w.grp = d.grp AND w.kind = d.kind")
def frame_rationale(x: Tables) -> DataFrame:
    why = F.lit("another reading")
    for (g, k), t in _WHY.items():
        why = F.when((F.col("grp") == g) & (F.col("kind") == k), t).otherwise(why)
    return frame_decide(x).select("scene_id", "id", "grp", why.alias("why"))


@query("amb_frame_unavailable", f"{_DECIDE.strip().split('SELECT scene_id, id, grp, kind FROM')[0]} SELECT scene_id, id, grp FROM (SELECT p.*, row_number() OVER (PARTITION BY scene_id, id, grp ORDER BY prior DESC, pos) AS n FROM p) q WHERE n = 1 AND NOT available")
def amb_frame_unavailable(x: Tables) -> DataFrame:
    """Where the frame with the highest prior can't be built."""
    top = decided(x).groupBy("scene_id", F.col("a_id").alias("id"), "grp").agg(F.max_by("available", F.struct("prior", (-F.col("pos")).alias("o"))).alias("available"))
    return top.where("not available").select("scene_id", "id", "grp")


@query("amb_world_undetermined", "SELECT scene_id, forward_margin < 0.12E0 AS undetermined FROM fx_rooms")
def amb_world_undetermined(x: Tables) -> DataFrame:
    return x.rooms.select("scene_id", (F.col("forward_margin") < 0.12).alias("undetermined"))
