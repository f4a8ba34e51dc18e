"""Ordinals, superlatives and nearest-of rankings as windows over the candidates of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, box_gap, horizontal, prefixed
from ..plans.config import CFG, MAX_ANCHORS


def room_frame(rooms: DataFrame, eye_x: float, eye_y: float) -> DataFrame:
    """scene_id, rx, ry: the right axis of a viewer who looks at the room's middle."""
    lx, ly = horizontal((F.col("x0") + F.col("x1")) / 2 - eye_x, (F.col("y0") + F.col("y1")) / 2 - eye_y)
    return rooms.select("scene_id", ly.alias("rx"), (-lx).alias("ry"))


def line_up(objects: DataFrame, axes: DataFrame, by: list[str]) -> DataFrame:
    """Candidates along an axis: key, width, place from its start, n, and the gap to the one before."""
    box = Box("o")
    rows = prefixed(objects, "o", ("scene_id", "label", "id")).join(axes, "scene_id")
    rx, ry = F.col("rx"), F.col("ry")
    rows = rows.select("scene_id", "label", "id", F.round(box.cx * rx + box.cy * ry, 9).alias("key"), (2.0 * box.radius(rx, ry)).alias("width"))
    w = Window.partitionBy(*by).orderBy("key", "id")
    return rows.select("*", F.row_number().over(w).cast("long").alias("place"), F.count("*").over(Window.partitionBy(*by)).alias("n"), (F.col("key") - F.lag("key").over(w)).alias("gap"))


def order_measures() -> list[Column]:
    return [(F.max("key") - F.min("key")).alias("spread"), F.avg("width").alias("mean_width"), F.min("gap").alias("min_gap"), F.median("gap").alias("median_gap")]


def degenerate() -> Column:
    """Whether candidates are not spread along the axis."""
    return F.col("spread") < CFG.ordinal_min_spread * F.col("mean_width")


def fragile() -> Column:
    return (F.col("min_gap") < CFG.ordinal_min_gap) | (F.col("min_gap") < CFG.ordinal_gap_ratio * F.col("median_gap"))


def in_middle() -> Column:
    p, n = F.col("place"), F.col("n")
    return F.when(n % 2 == 1, p * 2 == n + 1).otherwise((p * 2 == n) | (p * 2 == n + 2))


def from_landmark(objects: DataFrame, label: str) -> DataFrame:
    """Objects of other classes by distance from the largest object of a class."""
    size = F.struct((F.col("hx") * F.col("hy") * F.col("hz")).alias("v"), (-F.col("id")).alias("o"))
    mark = objects.where(F.col("label") == label).groupBy("scene_id").agg(F.max_by(F.struct("cx", "cy", "cz"), size).alias("m"))
    d = [F.col(c) - F.col(f"m.{c}") for c in ("cx", "cy", "cz")]
    rows = objects.where(F.col("label") != label).join(mark, "scene_id").withColumn("key", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("scene_id", "label").orderBy(F.round("key", 9), "id")))


def by_size(objects: DataFrame) -> DataFrame:
    size = F.col("hx") * F.col("hy") * F.col("hz") * 8.0
    w = Window.partitionBy("scene_id", "label").orderBy(F.col("size").desc(), "id")
    return objects.select("scene_id", "label", "id", size.alias("size")).select("*", F.row_number().over(w).alias("rank"), F.lead("size").over(w).alias("next"), F.count("*").over(Window.partitionBy("scene_id", "label")).alias("n"))


def nearest(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """query_id, id, score: candidates by how close their gap to any anchor is to the smallest of all."""
    a = prefixed(objects, "a", ("scene_id",)).withColumnRenamed("a_label", "anchor")
    rank = F.row_number().over(Window.partitionBy("scene_id", "anchor").orderBy((F.col("a_hx") * F.col("a_hy") * F.col("a_hz")).desc(), "a_id"))
    t = prefixed(objects, "t", ("scene_id",)).withColumnRenamed("t_label", "target")
    rows = queries.select("query_id", "scene_id", "target", "anchor").join(a.withColumn("q", rank).where(F.col("q") <= MAX_ANCHORS), ["scene_id", "anchor"]).join(t, ["scene_id", "target"]).where("t_id <> a_id")
    gap = rows.groupBy("query_id", F.col("t_id").alias("id")).agg(F.min(F.greatest(F.lit(0.0), box_gap(Box("t"), Box("a")))).alias("gap"))
    lo = F.min("gap").over(Window.partitionBy("query_id"))
    return gap.withColumn("lo", lo).withColumn("score", F.when(F.col("gap") <= F.col("lo") + 1e-9, 1.0).otherwise(F.least(F.lit(1.0), (F.col("lo") + 0.05) / (F.col("gap") + 0.05))))
