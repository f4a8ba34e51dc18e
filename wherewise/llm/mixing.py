"""Mixing sources to target weights: fixed-length blocks, multinomial counts per output shard, pseudorandom permutations.

1. Within a source, documents stand in a fixed pseudorandom order; their words form one stream, cut into blocks of BLOCK words.
   Positions are prefix sums in two levels (buckets of a source, then documents of a bucket), so no source meets in one task.
2. Each source gets as many slots as its target needs. Output shards of SLOTS slots draw how many slots each source fills:
   a multinomial draw, halving the range of shards again and again, conditioned on the totals so that quotas are met. A shard's
   counts depend on the seed and its place only, whoever computes them.
3. Slot k of a source takes block perm(k mod blocks), a keyed bijection of its own for each pass over the source.
4. Blocks are joined to documents by (source, block).

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share SHARE of all words; a source's target stops at
REPEAT times its words, and the excess is shared again by weight until none is above.

Cases: a null text has size 0 and is never taken. A null source is a source of its own, the last. Rows that repeat everything
are documents of their own. Documents of size 0 and sources without words get taken 0 and target 0. An empty table gives none.
The number of sources, unlike that of documents, is assumed to fit one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_names, text_of

#: Words of a block; slots of an output shard; share of all words; most passes over a source; weights of sources in turn.
BLOCK, SLOTS, SHARE, REPEAT, WEIGHTS, SEED = 128, 4096, 1.5, 2.0, (5.0, 2.0, 1.0), 20240501

_M = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def permute(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0 ... n-1, applied to k: a Feistel network over the next even power of two, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = _M((1 << half) - 1)
    keys = _mix(np.arange(1, 5, dtype=_M) + _M(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = k.astype(_M).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> _M(half), x & mask
        for r in keys:
            left, right = right, left ^ (_mix(right + r) & mask)
        x = (left << _M(half)) | right
        out[todo] = x
        todo = todo[x >= _M(n)]
    return out.astype(np.int64)


def halve(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `take` slots go to each source if counts is what all slots hold: multinomial, within what is there."""
    total = int(counts.sum())
    if take >= total:
        return counts.copy()
    got = rng.multinomial(take, counts / total).astype(np.int64)
    low, high = np.maximum(0, counts - (total - take)), np.minimum(counts, take)
    got = np.clip(got, low, high)
    off = take - int(got.sum())
    while off:  # what the bounds took away goes where there is room, in proportion to it
        room = (high - got) if off > 0 else (got - low)
        step = np.minimum(room, np.ceil(room * (abs(off) / room.sum())).astype(np.int64))
        cum = np.cumsum(step)
        step = np.where(cum <= abs(off), step, np.maximum(0, abs(off) - (cum - step)))
        got = got + step if off > 0 else got - step
        off = take - int(got.sum())
    return got


def shard_counts(quota: np.ndarray, shards: int, slots: int, lo: int, hi: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, counts by source, slots of the source before it) of shards lo ... hi-1."""

    def walk(a: int, b: int, counts: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= lo or a >= hi:
            return
        if b - a == 1:
            yield a, counts, before
            return
        mid = (a + b) // 2
        left = halve(counts, (mid - a) * slots, np.random.default_rng([seed, a, b]))
        yield from walk(a, mid, left, before)
        yield from walk(mid, b, counts - left, before + left)

    yield from walk(0, shards, quota, np.zeros_like(quota))


def source_targets(sizes: DataFrame, share: float, repeat: float, weights: tuple[float, ...]) -> DataFrame:
    """Of rows (source, source_size): with place and target. The common level is found by a running sum over sources in the order in which they fill up."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(nth, F.lit(len(weights))) + 1)
    x = sizes.select("source", "source_size", nth.alias("place"), w.alias("w"), (F.col("source_size") * F.lit(repeat)).alias("cap"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(share)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "place")
    x = x.select("*", (F.sum("cap").over(fill) - F.col("cap")).alias("filled"), (F.sum("w").over(Window.partitionBy(F.lit(1))) - F.sum("w").over(fill) + F.col("w")).alias("rest"), total.alias("total"))
    # a source that comes first with cap above its share of what is left sets the level for all after it
    level = F.min(F.when(F.col("cap") * F.col("rest") >= (F.col("total") - F.col("filled")) * F.col("w"), F.struct("filled", F.col("total").alias("t"), "rest"))).over(Window.partitionBy(F.lit(1)))
    x = x.withColumn("level", F.when(level.isNotNull() & (level["rest"] > 0), (level["t"] - level["filled"]) / level["rest"]))
    return x.select("source", "source_size", "place", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def _size(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, slots: int = SLOTS, share: float = SHARE, repeat: float = REPEAT, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: doc_id, row_key, source, size, source_size, target, taken, one per input row. pieces: for each
    block of a document that the mix takes: doc_id, row_key, from_word, n_words, passes (1 ... repeat)."""
    spark = docs.sparkSession
    text = F.col(text_col)
    base = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _size(text).alias("size"), F.xxhash64(text_of(text)).alias("row_key")), "mix-base")
    sources = cut(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), share, repeat, weights), "mix-sources")
    buckets = max(1, math.isqrt(base.count()))  # as many buckets as documents in one: both levels of the sums stay small
    rows = base.join(sources, base["source"].eqNullSafe(sources["source"])).select("doc_id", base["source"], "size", "row_key", "place", "source_size", "target")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(buckets)))

    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    first = sums.select("place", "bucket", (F.sum("n").over(Window.partitionBy("place").orderBy("bucket")) - F.col("n")).alias("first"))
    within = F.sum("size").over(Window.partitionBy("place", "bucket").orderBy("doc_id", "row_key", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = cut(rows.withColumn("within", within).join(first, ["place", "bucket"]).withColumn("start", F.col("first") + F.col("within")).drop("first", "within", "bucket"), "mix-rows")

    # slots: of each source as many as its target needs at the mean size of its blocks, and at most `repeat` passes
    known = [(int(r.place), int(r.source_size), float(r.target)) for r in sources.where("source_size > 0").select("place", "source_size", "target").orderBy("place").toLocalIterator()]
    if not known:
        return rows.select("doc_id", "row_key", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")), rows.select("doc_id", "row_key", F.lit(0).cast("long").alias("from_word"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("passes")).limit(0)
    place = np.array([k[0] for k in known])
    blocks = np.array([-(-k[1] // block) for k in known], dtype=np.int64)
    quota = np.array([min(int(repeat) * int(b), round(k[2] / k[1] * int(b))) for k, b in zip(known, blocks, strict=True)], dtype=np.int64)
    shards = max(1, -(-int(quota.sum()) // slots))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["id"].to_numpy()
            for a in range(0, len(ids), 64):
                for _, counts, before in shard_counts(quota, shards, slots, int(ids[a]), int(ids[a : a + 64][-1]) + 1, seed):
                    for s in np.flatnonzero(counts):
                        k = np.arange(before[s], before[s] + counts[s], dtype=np.int64)
                        turn = k // blocks[s]
                        for t in np.unique(turn):
                            at = permute(k[turn == t] % blocks[s], int(blocks[s]), seed * 1_000_003 + int(place[s]) * 7919 + int(t))
                            yield pd.DataFrame({"place": np.full(len(at), place[s], dtype="int32"), "block": at})

    drawn = spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInPandas(fill, "place int, block long")
    passes = drawn.groupBy("place", "block").agg(F.count("*").alias("passes"))

    covered = rows.where("size > 0").select("doc_id", "row_key", "place", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    # the planner takes the drawn slots for as few as their shards and would broadcast them
    pieces = covered.join(passes.hint("merge"), ["place", "block"]).select("doc_id", "row_key", "place", "start", (low - F.col("start")).alias("from_word"), (high - low).alias("n_words"), "passes")
    pieces = cut(pieces, "mix-pieces")
    # a document with words has a start of its own within its source
    taken = pieces.groupBy("place", "start").agg(F.sum(F.col("n_words") * F.col("passes")).alias("taken"))
    full = rows.where("size > 0").join(taken, ["place", "start"], "left").unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return full.select("doc_id", "row_key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")), pieces.select("doc_id", "row_key", "from_word", "n_words", "passes")


_word = re.compile("[^ \t\n\x0b\x0c\r]+")


def taken_text(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of a text in ranges (first, end) of word numbers, as they stand; ranges apart from each other by a line feed."""
    at = [(m.start(), m.end()) for m in _word.finditer(text)]
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in ranges)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", **parameters) -> DataFrame:
    """The mix as documents, with the columns of docs: for each document and pass a row with those of its words that the pass takes.

    Rows that repeat id and text alike are taken as often as the blocks of all of them; length_col, if there is one, is computed anew.
    """
    _, pieces = mixture(docs, id_col, text_col, source_col, **parameters)
    flat = pieces.select("doc_id", "row_key", "from_word", "n_words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))).alias("pass"))
    own, of_id, of_key, ranges_ = free_names(docs, "row", "of_id", "of_key", "ranges")
    lists = cut(flat.groupBy("doc_id", "row_key", "pass").agg(F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias(ranges_)), "mix-lists")
    lists = lists.select(F.col("doc_id").alias(of_id), F.col("row_key").alias(of_key), ranges_)
    keyed = docs.withColumn(own, F.xxhash64(text_of(F.col(text_col))))
    wide = keyed.join(lists, keyed[id_col].eqNullSafe(lists[of_id]) & (keyed[own] == lists[of_key])).select(*[docs[c] for c in docs.columns], ranges_)
    names, at = docs.columns, docs.columns.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = []
                for text, ranges in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                    joined: list[list[int]] = []
                    for r in ranges:
                        if joined and joined[-1][1] == r["from_word"]:
                            joined[-1][1] += r["n_words"]
                        else:
                            joined.append([r["from_word"], r["from_word"] + r["n_words"]])
                    texts.append(taken_text(text, joined))
                columns = [part.column(i) for i in range(len(names))]
                columns[at] = pa.array(texts, columns[at].type)
                if length is not None:
                    columns[length] = pa.array([len(t) for t in texts], columns[length].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return wide.mapInArrow(run, docs.schema)
