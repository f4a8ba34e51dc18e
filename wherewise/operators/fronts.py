"""Which way objects face: candidate faces, clearance, and votes of cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ramp

# fixed values: tolerance for standing against something, scale of clearance
AGAINST, SCALE = 0.45, 1.2


def faces(objects: DataFrame) -> DataFrame:
    """The four horizontal face normals: +x, -x, +y, -y of the box."""
    sides = [F.struct(F.lit(k).alias("side"), F.lit(float(sx)).alias("sx"), F.lit(float(sy)).alias("sy")) for k, (sx, sy) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1)))]
    rows = objects.withColumn("d", F.explode(F.array(*sides)))
    sx, sy = F.col("d.sx"), F.col("d.sy")
    return rows.select("*", F.col("d.side").alias("side"), (sx * F.col("ux") - sy * F.col("uy")).alias("dx"), (sx * F.col("uy") + sy * F.col("ux")).alias("dy")).drop("d")


def clearance(objects: DataFrame, rooms: DataFrame) -> DataFrame:
    """scene_id, id, side, free: from each face to the room's bounds along its normal."""
    rows = faces(objects).join(rooms.select("scene_id", "x0", "x1", "y0", "y1"), "scene_id")
    dx, dy = F.col("dx"), F.col("dy")
    edge = F.greatest(F.col("x0") * dx, F.col("x1") * dx) + F.greatest(F.col("y0") * dy, F.col("y1") * dy)
    face = F.col("cx") * dx + F.col("cy") * dy + F.when(F.col("side") < 2, F.col("hx")).otherwise(F.col("hy"))
    return rows.select("scene_id", "id", "side", F.greatest(F.lit(0.0), edge - face).alias("free"))


def _sides(free: DataFrame) -> DataFrame:
    return free.groupBy("scene_id", "id").agg(*[F.max(F.when(F.col("side") == k, F.col("free"))).alias(f"f{k}") for k in range(4)])


def _asymmetry() -> tuple[Column, Column]:
    return F.abs(F.col("f0") - F.col("f1")), F.abs(F.col("f2") - F.col("f3"))


def wall_cue(free: DataFrame) -> DataFrame:
    """weight: how far the object stands against something on one side only."""
    x, y = _asymmetry()
    gate = 1.0 - ramp(F.least("f0", "f1", "f2", "f3"), AGAINST, AGAINST * 2.5)
    return _sides(free).withColumn("weight", gate * ramp(F.greatest(x, y), 0.25, SCALE))


def by_wall(free: DataFrame) -> DataFrame:
    """side and confidence by clearance alone: the axis with the larger asymmetry, its freer end."""
    x, y = _asymmetry()
    side = F.when(x >= y, F.when(F.col("f0") >= F.col("f1"), 0).otherwise(1)).otherwise(F.when(F.col("f2") >= F.col("f3"), 2).otherwise(3))
    return _sides(free).select("scene_id", "id", side.alias("side"), F.try_divide(F.abs(x - y), x + y).alias("confidence"))


def face_points(objects: DataFrame, points: DataFrame) -> DataFrame:
    """face_0 ... face_3: points in the outer slab behind each face."""
    rows = objects.select("scene_id", "id", "cx", "cy", "hx", "hy", "ux", "uy").join(points, ["scene_id", "id"])
    lx = (F.col("x") - F.col("cx")) * F.col("ux") + (F.col("y") - F.col("cy")) * F.col("uy")
    ly = (F.col("y") - F.col("cy")) * F.col("ux") - (F.col("x") - F.col("cx")) * F.col("uy")
    rows = rows.withColumns({"lx": lx, "ly": ly})
    hits = [F.col("lx") > F.col("hx") * 0.72, F.col("lx") < F.col("hx") * -0.72, F.col("ly") > F.col("hy") * 0.72, F.col("ly") < F.col("hy") * -0.72]
    return rows.groupBy("scene_id", "id").agg(*[F.count_if(h).alias(f"face_{k}") for k, h in enumerate(hits)])
