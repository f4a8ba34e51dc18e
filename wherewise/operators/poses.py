"""Camera poses (ex, ey, ez, fwd_x, fwd_y; upright) against objects: joins on the scene and arg-max aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half size of the cube that stands for an anchor's centre; share of the view that an object should fill.
CUBE, FILL = 0.05, 0.18


def project(x: Column, y: Column, z: Column, focal: float = 500.0, cu: float = 320.0, cv: float = 240.0) -> tuple[Column, Column, Column]:
    """Picture coordinates and depth in front of a pose; null coordinates behind it."""
    dx, dy = x - F.col("ex"), y - F.col("ey")
    depth = dx * F.col("fwd_x") + dy * F.col("fwd_y")
    side = dx * F.col("fwd_y") - dy * F.col("fwd_x")
    ahead = depth > 1e-6
    safe = F.when(ahead, depth).otherwise(1.0)
    return F.when(ahead, cu + focal * side / safe), F.when(ahead, cv - focal * (z - F.col("ez")) / safe), depth


def _with_distance(objects: DataFrame, poses: DataFrame) -> DataFrame:
    dx, dy, dz = F.col("cx") - F.col("ex"), F.col("cy") - F.col("ey"), F.col("cz") - F.col("ez")
    rows = objects.select("scene_id", "id", "cx", "cy", "cz").join(poses, "scene_id")
    return rows.withColumns({"d": F.sqrt(dx * dx + dy * dy + dz * dz), "ahead": dx * F.col("fwd_x") + dy * F.col("fwd_y")})


def nearest(objects: DataFrame, poses: DataFrame) -> DataFrame:
    return _with_distance(objects, poses).groupBy("scene_id", "id").agg(F.min_by("idx", F.struct(F.round("d", 9).alias("d"), "idx")).alias("idx"))


def best_view(objects: DataFrame, poses: DataFrame) -> DataFrame:
    """On-axis share times a log-normal of distance; poses that look away or stand too close don't count."""
    radius = max(0.05, (3 * CUBE * CUBE) ** 0.5)
    spread = F.log(F.col("d") / max(radius / FILL, 0.5)) / 0.55
    rows = _with_distance(objects, poses).where(F.col("d") >= 1.25 * radius).withColumn("axis", F.col("ahead") / F.col("d")).where("axis > 0.25")
    score = F.col("axis") * F.exp(spread * spread * -0.5)
    return rows.groupBy("scene_id", "id").agg(F.max_by("idx", F.struct(F.round(score, 9).alias("s"), (-F.col("idx")).alias("o"))).alias("idx"))
