"""Connected components by alternating large-star and small-star, as joins and aggregates of edge tables.

Each round ends in a table in the shared folder, so lineage stays short and a lost executor costs one round. Hot centres are
reduced by partial aggregation (min) and joined back with a plain equi-join, which the adaptive planner can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: rows (u, v), u > v. large: links each larger neighbour to the smallest of the neighbourhood; else each smaller one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    seen = both.join(least, "u")
    if large:
        out = seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (id, component) for every id in edges (columns a, b); component is the smallest id that can be reached. Self-links and nulls add nothing."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct()
    now = cut(now, "cc-0")
    mark = _mark(now)
    for i in range(max_rounds):
        now = cut(_stars(_stars(now, True), False), f"cc-{i + 1}")
        before, mark = mark, _mark(now)
        if mark == before:  # every edge now leads to the smallest id of its component
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError(f"components: not stable after {max_rounds} rounds")
