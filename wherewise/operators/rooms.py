"""Rooms from points: bounds, walls, common direction, forward side, and shelf levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import r9


def levels(objects: DataFrame, step: float = 0.25, least: int = 5) -> DataFrame:
    """scene_id, z, n, idx, levels: heights of tops, rounded, that at least `least` objects share."""
    z = F.round((F.col("cz") + F.col("hz")) / step) * step
    rows = objects.select("scene_id", z.alias("z")).groupBy("scene_id", "z").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.select("*", (F.row_number().over(Window.partitionBy("scene_id").orderBy("z")) - 1).alias("idx"), F.count("*").over(Window.partitionBy("scene_id")).alias("levels"))


def manhattan(objects: DataFrame) -> DataFrame:
    t, w = F.atan2("uy", "ux") * 4, 4 * (F.col("hx") + F.col("hy")) * F.col("hz")
    s = objects.groupBy("scene_id").agg(F.sum(w * F.cos(t)).alias("c"), F.sum(w * F.sin(t)).alias("s"), F.sum(w).alias("w"))
    return s.select("scene_id", (F.atan2("s", "c") / 4).alias("axis"), (F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("w")).alias("resultant"))


def walls(points: DataFrame, slab: float = 0.25, quantile: float = 0.995, cell: float = 0.1) -> DataFrame:
    """scene_id, side (0 +x, 1 -x, 2 +y, 3 -y), edge, support, area of occupied cells."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy")) for k, (dx, dy) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1)))]))
    rows = points.withColumn("d", sides).select("scene_id", "d.side", (F.col("x") * F.col("d.dx") + F.col("y") * F.col("d.dy")).alias("s"), (F.col("x") * F.col("d.dy") - F.col("y") * F.col("d.dx")).alias("a"), "z")
    edge = rows.groupBy("scene_id", "side").agg(F.percentile("s", quantile).alias("edge"))
    near = rows.join(edge, ["scene_id", "side"]).where(F.abs(F.col("s") - F.col("edge")) <= slab)
    cells = near.groupBy("scene_id", "side", "edge", F.floor(F.col("a") / cell).alias("i"), F.floor(F.col("z") / cell).alias("j")).agg(F.count("*").alias("n"))
    return cells.groupBy("scene_id", "side", "edge").agg(F.sum("n").alias("support"), (F.count("*") * cell * cell).alias("area"))


def bounds(points: DataFrame) -> DataFrame:
    q = lambda c, p: F.percentile(c, p)
    top = q("z", 0.998)
    return points.groupBy("scene_id").agg(r9(q("z", 0.002)).alias("floor_z"), r9(F.when(top >= 1.2, top)).alias("ceiling_z"), *[r9(q(c, p)).alias(f"{c}{i}") for c in "xy" for i, p in ((0, 0.001), (1, 0.999))])


def forward(points: DataFrame, poses: DataFrame) -> DataFrame:
    """scene_id, side, best, margin: 0.6 of the wall's share of the largest area and 0.4 of the mean heading towards it."""
    heading = poses.groupBy("scene_id").agg(F.avg("fwd_x").alias("hx"), F.avg("fwd_y").alias("hy"))
    towards = F.when(F.col("side") == 0, F.col("hx")).when(F.col("side") == 1, -F.col("hx")).when(F.col("side") == 2, F.col("hy")).otherwise(-F.col("hy"))
    share = F.col("area") / F.max("area").over(Window.partitionBy("scene_id"))
    scored = walls(points).withColumn("share", share).join(heading, "scene_id").withColumn("score", 0.6 * F.col("share") + 0.4 * F.greatest(F.lit(0.0), towards))
    w = Window.partitionBy("scene_id").orderBy(F.col("score").desc(), "side")
    top = scored.select("scene_id", "side", "score", F.row_number().over(w).alias("n"), F.lead("score").over(w).alias("second")).where("n = 1")
    return top.select("scene_id", "side", F.col("score").alias("best"), F.least(F.lit(1.0), F.col("score") - F.col("second")).alias("margin"))


def detect_levels(points: DataFrame, step: float = 0.02, apart: float = 0.12) -> DataFrame:
    """Peaks of a histogram of heights, greedily; sequential within an object, parallel over objects."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf["z"].to_numpy()
        cells, counts = np.unique(np.floor(z / step).astype(int), return_counts=True)
        taken: list[tuple[float, int]] = []
        for i in np.lexsort((cells, -counts)):
            if all(abs(cells[i] * step - t) >= apart for t, _ in taken):
                taken.append((cells[i] * step, int(counts[i])))
        taken.sort()
        return pd.DataFrame([(*key, i, t, n) for i, (t, n) in enumerate(taken)], columns=["scene_id", "id", "idx", "z", "support"])

    return points.groupBy("scene_id", "id").applyInPandas(run, "scene_id long, id long, idx long, z double, support long")
