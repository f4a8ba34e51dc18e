"""Sources and sinks: scene tables, items and pairs as JSON lines, PLY meshes, configuration, and the catalog of cached scenes."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import Config

#: Version of stored scenes; readers refuse others.
SCHEMA_VERSION = 3
ITEM = "id string, scene_id string, dataset string, text string, target_ids array<long>, ambiguous boolean, ambiguity_kind string, relation string, relation_type string, frame string, frame_stated_in_text boolean, viewpoint_mode string, viewpoint_index long, viewpoint_position array<double>, viewpoint_landmark string, difficulty string, annotator string, source string, notes string, schema_version int"


def scratch(spark: SparkSession) -> str:
    """A new folder in the store that executors share (spark.checkpoint.dir); of our own only where that is unset and the master is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/wherewise-io/{uuid.uuid4().hex}"


def scene_key(dataset: Column, scene: Column, tag: Column | None = None) -> Column:
    return F.concat_ws("__", dataset, scene, *([] if tag is None else [F.when(tag != "", tag)]))


def write_scenes(tables: dict[str, DataFrame], path: str) -> None:
    """Each table in a folder of its own, partitioned by scene, with the version that readers check."""
    for name, df in tables.items():
        df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").partitionBy("scene_id").parquet(f"{path}/{name}")


def read_scenes(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of stored scenes; the folder of a scene is the only one that a filter on it reads."""
    df = spark.read.parquet(f"{path}/{name}")
    known = F.when(F.col("schema_version") == SCHEMA_VERSION, True).otherwise(F.raise_error(F.concat(F.lit("stored with schema version "), F.col("schema_version"))).cast("boolean"))
    return df.where(known).drop("schema_version")


def catalog(objects: DataFrame) -> DataFrame:
    """scene_id, n_objects, stale of stored scenes."""
    return objects.groupBy("scene_id").agg(F.count("*").alias("n_objects"), F.bool_or(F.col("schema_version") != SCHEMA_VERSION).alias("stale"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_items(spark: SparkSession, *paths: str) -> DataFrame:
    """Items from files of JSON lines; blank lines and comments (// or #) don't count, a bad line or an id that occurs twice is an error."""
    lines = spark.read.text(list(paths)).where(~F.col("value").rlike(r"^\s*(?://|#|$)"))
    items = lines.select(F.from_json("value", ITEM, {"mode": "FAILFAST"}).alias("i")).select("i.*")
    twice = items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("twice"), F.min("id").alias("first"))
    ok = F.when(F.col("twice") == 0, True).otherwise(F.raise_error(F.concat(F.lit("id occurs twice: "), F.col("first"))).cast("boolean"))
    return items.crossJoin(F.broadcast(twice)).where(ok).drop("twice", "first")


def parse_ply(data: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Points, colours (if there are) and triangles of a PLY file, ascii or little-endian."""
    head, _, body = data.partition(b"end_header\n")
    lines = head.decode().split("\n")
    kind = next(x.split()[1] for x in lines if x.startswith("format"))
    types = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int": "<i4", "int32": "<i4", "uint": "<u4", "short": "<i2", "ushort": "<u2"}
    elements: list[tuple[str, int, list]] = []
    for x in lines:
        w = x.split()
        if w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(w[1:])
    points, colours, faces = np.zeros((0, 3)), None, np.zeros((0, 3), dtype=int)
    words, at = (body.split(), 0) if kind == "ascii" else (None, 0)
    for name, n, props in elements:
        if not any(p[0] == "list" for p in props):
            fields = [(p[1], types[p[0]]) for p in props]
            if words is not None:
                rows = np.array(words[at : at + n * len(props)], dtype=float).reshape(n, len(props))
                table = {p[1]: rows[:, i] for i, p in enumerate(props)}
                at += n * len(props)
            else:
                block = np.frombuffer(body, dtype=fields, count=n, offset=at)
                table = {f: block[f] for f, _ in fields}
                at += block.nbytes
            if name == "vertex":
                points = np.stack([table[c] for c in "xyz"], axis=1).astype(float)
                if all(c in table for c in ("red", "green", "blue")):
                    colours = np.stack([table[c] for c in ("red", "green", "blue")], axis=1).astype(np.uint8)
        else:
            out, (_, count_type, item_type, _) = [], props[0]
            for _ in range(n):
                if words is not None:
                    k = int(words[at])
                    idx = list(map(int, words[at + 1 : at + 1 + k]))
                    at += 1 + k
                else:
                    c, t = np.dtype(types[count_type]), np.dtype(types[item_type])
                    k = int(np.frombuffer(body, c, 1, at)[0])
                    idx = np.frombuffer(body, t, k, at + c.itemsize).tolist()
                    at += c.itemsize + k * t.itemsize
                if k == 3:
                    out.append(idx)
            if name == "face" and out:
                faces = np.array(out, dtype=int)
    return points, colours, faces


def format_ply(points: np.ndarray, colours: np.ndarray | None = None) -> bytes:
    """A little-endian PLY file; colours of floats in [0, 1] become bytes."""
    out = io.BytesIO()
    names = [("x", "double"), ("y", "double"), ("z", "double")] + ([("red", "uchar"), ("green", "uchar"), ("blue", "uchar")] if colours is not None else [])
    out.write(("ply\nformat binary_little_endian 1.0\n" + f"element vertex {len(points)}\n" + "".join(f"property {t} {n}\n" for n, t in names) + "end_header\n").encode())
    block = np.zeros(len(points), dtype=[(n, "<f8" if t == "double" else "u1") for n, t in names])
    for i, c in enumerate("xyz"):
        block[c] = points[:, i]
    if colours is not None:
        rgb = np.clip(colours * 255, 0, 255).astype(np.uint8) if np.issubdtype(colours.dtype, np.floating) else colours
        for i, c in enumerate(("red", "green", "blue")):
            block[c] = rgb[:, i]
    out.write(block.tobytes())
    return out.getvalue()


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """path, vertex, x, y, z of all PLY files under a path: a file is one task's work."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                xyz, _, _ = parse_ply(data)
                yield pd.DataFrame({"path": p, "vertex": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, vertex long, x double, y double, z double")


def ply_files(points: DataFrame) -> DataFrame:
    """scene_id and the bytes of a PLY file of its points."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], format_ply(pdf.sort_values(["id", "pt_idx"])[["x", "y", "z"]].to_numpy()))], columns=["scene_id", "content"])

    return points.groupBy("scene_id").applyInPandas(run, "scene_id long, content binary")


def config_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Thresholds as one row."""
    from dataclasses import asdict

    c = asdict(Config.load(path))
    return spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} double" for k in c))


def scene_payload(objects: DataFrame, poses: DataFrame, most: int = 400) -> DataFrame:
    """scene_id and a JSON text of its objects and of at most `most` poses at even steps."""
    o = objects.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", "cx", "cy", "cz"))).alias("objects"))
    n = poses.groupBy("scene_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).alias("step"))
    p = poses.join(n, "scene_id").where(F.col("idx") % F.col("step") == 0).groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("idx", "ex", "ey"))).alias("poses"))
    return o.join(p, "scene_id", "left").select("scene_id", F.to_json(F.struct("objects", "poses")).alias("payload"))


def dumps(value) -> str:
    """JSON of nested values that may hold numpy ones."""
    return json.dumps(value, sort_keys=True, default=lambda v: v.tolist() if hasattr(v, "tolist") else str(v))
