"""Reports as lines of markdown, maps in characters, and the agglomeration of segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """line_no, line: a header, a rule and one line per row. For aggregates of a few rows."""
    show = [F.coalesce(F.when(F.lit(t) == "double", F.format_number(F.col(c).cast("double"), 3)).otherwise(F.col(c).cast("string")) if t == "double" else F.col(c).cast("string"), F.lit("-")) for c, t in rows.dtypes if c in columns]
    names = [c for c, _ in rows.dtypes if c in columns]
    body = rows.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *show), F.lit(" |")).alias("line"))
    # literals, as a table made of Python rows starts Python on the executors
    head = rows.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(v).alias("line")) for n, v in ((-1, "| " + " | ".join(names) + " |"), (0, "|" + "-|" * len(names)))])))
    return head.union(body).select(F.col("n").alias("line_no"), "line")


def text_map(objects: DataFrame, width: int = 40, height: int = 20) -> DataFrame:
    """scene_id, row, line: a plan seen from above, the first letter of what stands highest in each cell."""
    b = objects.groupBy("scene_id").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    cell = lambda v, lo, hi, n: F.least(F.lit(n - 1), F.floor((F.col(v) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) * n)).cast("int")
    o = objects.join(b, "scene_id").select("scene_id", cell("cx", "x0", "x1", width).alias("i"), cell("cy", "y0", "y1", height).alias("j"), F.upper(F.left("label", F.lit(1))).alias("c"), (F.col("cz") + F.col("hz")).alias("top"), "id")
    top = o.groupBy("scene_id", "j", "i").agg(F.max_by("c", F.struct("top", "id")).alias("c"))
    marks = top.groupBy("scene_id", "j").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit("."))), "")
    return marks.select("scene_id", F.col("j").alias("row"), line.alias("line"))


def agglomerate(segments: DataFrame, points: DataFrame, reach: float = 0.8, most: float = 3.0) -> DataFrame:
    """scene_id, segment, object: segments merge with their nearest neighbour while what they make stays small; greedy within a scene."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.groupby("segment")[["x", "y", "z"]]
        lo, hi = g.min().to_numpy(), g.max().to_numpy()
        ids = np.array(sorted(pdf["segment"].unique()))
        owner = np.arange(len(ids))
        gap = np.linalg.norm(np.maximum(0, np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None])), axis=2)
        for d, i, j in sorted((gap[i, j], i, j) for i in range(len(ids)) for j in range(i) if gap[i, j] <= reach):
            a, b = owner[i], owner[j]
            if a != b:
                both = (owner == a) | (owner == b)
                if np.linalg.norm(hi[both].max(axis=0) - lo[both].min(axis=0)) <= most:
                    owner[both] = min(a, b)
        return pd.DataFrame({"scene_id": pdf["scene_id"].iloc[0], "segment": ids, "object": ids[owner]})

    return segments.join(points, ["scene_id", "id", "pt_idx"]).groupBy("scene_id").applyInPandas(run, "scene_id long, segment long, object long")


def visible_share(points: DataFrame, poses: DataFrame, half_angle_cos: float = 0.5, least: float = 0.25) -> DataFrame:
    """scene_id, id, idx, share: the share of an object's points that a pose has in view."""
    dx, dy, dz = F.col("x") - F.col("ex"), F.col("y") - F.col("ey"), F.col("z") - F.col("ez")
    d = F.sqrt(dx * dx + dy * dy + dz * dz)
    seen = (d > least) & (dx * F.col("fwd_x") + dy * F.col("fwd_y") > d * half_angle_cos)
    return points.join(poses, "scene_id").groupBy("scene_id", "id", "idx").agg(F.avg(F.when(seen, 1.0).otherwise(0.0)).alias("share"))


def sampled(df: DataFrame, by: list[str], key: list[str], most: int) -> DataFrame:
    """At most `most` rows of each group, the same in every run: those of the smallest keyed hashes."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(*key), *key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def poster_score(spread: Column, depth: Column, share: Column) -> Column:
    """How well a pose composes a picture of what it should show: in view, of fitting size, not too spread."""
    return share * F.exp(-0.5 * F.pow(F.log(F.greatest(depth, F.lit(0.1)) / 2.5) / 0.6, 2)) * F.exp(-spread / 4.0)
