"""What the operators of this package share: inputs, durable cuts and text folding."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it; on a cluster without that folder, submit it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    # rows are whole texts here: ten thousand of them, the default, are too much for one Arrow batch
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="wherewise-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/wherewise/{tag}-{uuid.uuid4().hex}"


#: Tables that cut() wrote inside scratch() blocks that are open.
_scratch: list[list[str]] = []


def cut(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Ends the lineage of df in a table in the shared folder, so that a lost executor costs one stage and not the whole plan. Inside a
    scratch() block the table lasts as long as the block, unless it is to be kept."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside go when the block ends, and with them the shuffle files of plans that nothing refers to any more."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_path(spark, path)
        release(spark)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of plans that nothing refers to any more go now; they stay until the driver's JVM collects those plans."""
    spark._jvm.System.gc()


#: A key is hot with more than one in HOT_SHARE of all rows (and HOT_LEAST of them); its rows are then dealt to SALTS tasks.
HOT_SHARE, HOT_LEAST, SALTS = 500, 100, 32


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, size: str = "n") -> DataFrame:
    """big joined to small (one row a key, with its number of rows in big as `size`) on keys; rows of hot keys are dealt by hash of the column
    spread, and the row of small goes to each of their tasks. big should be a table, as its rows are counted. There are less than HOT_SHARE
    hot keys, so these are broadcast."""
    bound = max(HOT_LEAST, big.count() // HOT_SHARE)
    hot, salt = free_names(big.join(small.limit(0), keys), "hot", "salt")
    marks = small.where(F.col(size) > bound).select(*keys, F.lit(True).alias(hot))
    left = big.join(F.broadcast(marks), keys, "left").withColumn(salt, F.when(F.col(hot), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop(hot)
    every = F.when(F.col(size) > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(small.withColumn(salt, F.explode(every)), [*keys, salt]).drop(salt)


#: Words of 64 bits of the filter that stands for keys which are too many to be broadcast.
FILTER_WORDS = 1 << 20


def sift(df: DataFrame, wanted: DataFrame, keys: list[str], most: int, words: int = FILTER_WORDS) -> DataFrame:
    """The rows of df whose keys are among the rows of wanted (a table of distinct keys), without a shuffle of df. Up to `most` keys are broadcast,
    and the result is exact; beyond that a filter of bits of bounded size is, which lets through all such rows and few others."""
    if wanted.limit(most + 1).count() <= most:
        return df.join(F.broadcast(wanted), keys, "left_semi")
    word, own, bits = free_names(df, "word", "own", "bits")
    h = F.xxhash64(*keys)
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63)).cast("int"))
    at, three = F.pmod(h, F.lit(words)).cast("int"), one(40).bitwiseOR(one(47)).bitwiseOR(one(54))
    known = wanted.select(at.alias(word), three.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    return df.withColumns({word: at, own: three}).join(F.broadcast(known), word).where(F.col(bits).bitwiseAND(F.col(own)) == F.col(own)).drop(word, own, bits)


def by_group(df: DataFrame, keys: list[str], run: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """Rows that run returns for each group of df, as a dict of columns. As applyInPandas, but groups come out of sorted Arrow batches, one in
    memory at a time, so that many small groups cost little each. Keys aren't null."""
    names, kinds = df.columns, [x.split() for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    out = pa.schema([(n, types[t]) for n, t in kinds])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, rows = [], None, []

        def done() -> list[tuple]:
            return run({n: [v for part in held for v in part.column(i).to_pylist()] for i, n in enumerate(names)})

        for batch in batches:
            columns = [batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
            bounds = [0, *changes, batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a == b:
                    continue
                own = tuple(c[a] for c in columns)
                if held and own != key:
                    rows += done()
                    held = []
                    if len(rows) > 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)
                        rows = []
                held.append(batch.slice(a, b - a))
                key = own
        if held:
            rows += done()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(go, schema)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store through Hadoop's file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(text: Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(text, F.lit(""))


def without_blanks(text: Column) -> Column:
    """Deletes every character of [\\x20\\x09-\\x0D]. Chained replace() scans bytes; regexp_replace and translate decode every character."""
    out = text_of(text)
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out
