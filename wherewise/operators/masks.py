"""Instances as sets of vertices: overlaps, matches, mesh edges, segments, and classification of embeddings."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch


def overlaps(masks: DataFrame) -> DataFrame:
    """gt_id, pred_id, n, iou of rows (vertex, gt_id, pred_id)."""
    both = masks.groupBy("gt_id", "pred_id").agg(F.count("*").alias("n"))
    g = masks.groupBy("gt_id").agg(F.count("*").alias("gs"))
    p = masks.groupBy("pred_id").agg(F.count("*").alias("ps"))
    return both.join(g, "gt_id").join(p, "pred_id").select("gt_id", "pred_id", "n", (F.col("n") / (F.col("gs") + F.col("ps") - F.col("n"))).alias("iou"))


def match(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one matches by overlap, then by the smaller ids.

    Pairs that are the best of both their instances are those that a greedy pass takes whatever comes before them. They are matched all at once,
    pairs of matched instances go, and so on while pairs are left; rounds are few unless overlaps descend along a long chain.
    """
    spark, folder = pairs.sparkSession, scratch(pairs.sparkSession)
    place = F.struct("iou", (-F.col("gt_id")).alias("g"), (-F.col("pred_id")).alias("p"))
    pairs.select("gt_id", "pred_id", "iou").write.parquet(f"{folder}/left=0")
    n = 0
    while not (left := spark.read.parquet(f"{folder}/left={n}")).isEmpty():
        best = lambda side: left.groupBy(side).agg(F.max(place).alias("b")).select((-F.col("b.g")).alias("gt_id"), (-F.col("b.p")).alias("pred_id"), "b.iou")  # noqa: B023, E731
        best("gt_id").join(best("pred_id").select("gt_id", "pred_id"), ["gt_id", "pred_id"], "left_semi").write.parquet(f"{folder}/kept/round={n}")
        kept = spark.read.parquet(f"{folder}/kept/round={n}")
        left.join(kept.select("gt_id"), "gt_id", "left_anti").join(kept.select("pred_id"), "pred_id", "left_anti").write.parquet(f"{folder}/left={n + 1}")
        n += 1
    return spark.read.parquet(f"{folder}/kept").select("gt_id", "pred_id", "iou") if n else pairs.select("gt_id", "pred_id", "iou").where("false")


def edges(masks: DataFrame) -> DataFrame:
    """Undirected edges (a < b) from each vertex to its neighbours, each once."""
    near = F.explode(F.array(F.col("vertex") + 8, F.col("vertex") + 1))
    return masks.select("vertex", near.alias("other")).select(F.least("vertex", "other").alias("a"), F.greatest("vertex", "other").alias("b")).distinct()


def adjacency(edges_: DataFrame, segments: DataFrame) -> DataFrame:
    """s, t, n: edges between each two segments."""
    p, q = segments.select(F.col("vertex").alias("a"), F.col("seg").alias("p")), segments.select(F.col("vertex").alias("b"), F.col("seg").alias("q"))
    rows = edges_.join(p, "a").join(q, "b").where("p <> q")
    return rows.groupBy(F.least("p", "q").alias("s"), F.greatest("p", "q").alias("t")).agg(F.count("*").alias("n"))


def segment(points: DataFrame, k: float = 0.6, radius: float = 0.8) -> DataFrame:
    """Graph segmentation of each scene: edges by length, components merge while the edge is short for both."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "pt_idx"]).reset_index(drop=True)
        p = pdf[["x", "y", "z"]].to_numpy()
        cells: dict[tuple, list[int]] = {}
        for i, c in enumerate(map(tuple, np.floor(p / radius).astype(int))):
            cells.setdefault(c, []).append(i)
        found = []
        for c, own in cells.items():
            around = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) for j in cells.get((c[0] + dx, c[1] + dy, c[2] + dz), ())]
            d = np.linalg.norm(p[own][:, None] - p[around][None], axis=2)
            for i, j in zip(*np.nonzero(d <= radius), strict=True):
                if own[i] < around[j]:
                    found.append((d[i, j], own[i], around[j]))
        parent, size, inner = list(range(len(p))), [1] * len(p), [0.0] * len(p)

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for w, i, j in sorted(found):
            a, b = root(i), root(j)
            if a != b and w <= min(inner[a] + k / size[a], inner[b] + k / size[b]):
                a, b = min(a, b), max(a, b)
                parent[b] = a
                size[a] += size[b]
                inner[a] = w
        return pdf[["scene_id", "id", "pt_idx"]].assign(segment=[root(i) for i in range(len(p))])

    return points.groupBy("scene_id").applyInPandas(run, "scene_id long, id long, pt_idx long, segment long")


def classify(embeddings: DataFrame, temperature: float = 100.0, labels: int = 2048) -> DataFrame:
    """vec_id, label, prob: the most likely label; one vector per label stands for its text.

    Vectors meet labels in blocks of about `labels`, as a matrix product; a vector leaves its largest logit, the sum of its exponentials and its
    label in each block, from which the softmax over all labels follows. Vectors without numbers, or of another length than the labels', are left out.
    """
    known = embeddings.where("label is not null and embedding is not null")
    first = known.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    texts = known.join(first, ["label", "vec_id"]).select(F.col("label").cast("long").alias("label"), "embedding").dropDuplicates(["label"])
    blocks = -(-first.count() // labels)
    block = F.pmod(F.xxhash64("label"), F.lit(max(blocks, 1)))
    parts = [_logits(embeddings, texts.where(block == b).orderBy("label").toArrow(), temperature) for b in range(blocks)]
    found = functools.reduce(DataFrame.union, (p for p in parts if p is not None)) if blocks else embeddings.select("vec_id", F.lit(0.0).alias("top"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("label")).where("false")
    share = F.exp(F.col("top") - F.max("top").over(Window.partitionBy("vec_id")))
    found = found.select("vec_id", "label", "total", share.alias("share"))
    out = found.groupBy("vec_id").agg(F.min(F.struct((-F.round("share", 12)).alias("s"), "label", "share")).alias("b"), F.sum(F.col("share") * F.col("total")).alias("all"))
    return out.select("vec_id", "b.label", (F.col("b.share") / F.col("all")).alias("prob"))


def _logits(embeddings: DataFrame, texts: pa.Table, temperature: float) -> DataFrame | None:
    """For each vector the largest logit of a block of labels, the sum of exponentials relative to it, and its label; None for an empty block."""
    if not texts.num_rows:
        return None
    names = texts.column("label").to_numpy()
    vectors = np.array(texts.column("embedding").to_pylist(), dtype=np.float64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                logits = own @ vectors * temperature
                top = logits.max(axis=1)
                x = np.exp(logits - top[:, None])
                best = names[(np.round(x, 12) == 1.0).argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(top), pa.array(x.sum(axis=1)), pa.array(best, pa.int64())], names=["vec_id", "top", "total", "label"])

    rows = embeddings.where(F.size("embedding") == vectors.shape[0]).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, "vec_id long, top double, total double, label long")
