"""Line dedup: passages of two lines or more that repeat anywhere in the corpus are removed, found by rolling hash.

Two levels. At the finer one every place ends a chunk: the rolling hash over each two neighbouring lines is a key, counted over
all documents. So a chunk lies inside every shared run of two lines or more, whatever stands around it, and a run grows line by
line as its chunks overlap. Of a repeated key the first pair of lines (smallest id, text hash, then place) stays; others go if they
equal it byte for byte. A line that belongs to a first pair stays also where another pair would take it, so each repeated pair is
left whole once. Lines that repeat singly, between other neighbours, stay.

At the coarser level the rolling hash ends a chunk where it falls in one of DIVISOR classes, so boundaries depend on nearby lines
only and come back in step behind an insertion; a chunk has MIN_LINES to MAX_LINES lines. These chunks are what n_chunks counts,
and removed_chunks those of them that lost lines.

Texts move only as far as pairs repeat: keys are counted first, a second pass over the texts gives the repeated pairs with
their bytes. The list of what goes is joined to the documents at the end.

Cases: a null text is an empty one and is returned as it is. Blank lines are lines. Rows are told apart by id and text hash; rows that
repeat both keep a first pair alike. A text that loses all its lines becomes empty. A null id counts as smaller than all others. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Lines that the rolling hash covers; one place in DIVISOR ends a chunk; lines of a chunk.
ROLL, DIVISOR, MIN_LINES, MAX_LINES = 2, 2, 2, 16
#: Keys, and documents with removals, that are broadcast at most (8 and some 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_KEYS, BROADCAST_DOCS = 1_000_000, 200_000

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def chunks(lines: list[str], roll: int = ROLL, divisor: int = DIVISOR, least: int = MIN_LINES, most: int = MAX_LINES) -> list[tuple[int, int]]:
    """(first, end) line numbers of the chunks of a text. The last chunk may be shorter than `least`."""
    drop = pow(_BASE, roll, 1 << 64)
    hashes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    out, start, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h) & _MASK
        if i >= roll:
            rolling = (rolling - hashes[i - roll] * drop) & _MASK
        n = i + 1 - start
        if n >= most or (n >= least and (rolling >> 32) % divisor == 0):
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def pair_keys(lines: list[str]) -> np.ndarray:
    """The rolling hash over lines i and i + 1, for each i."""
    h = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], dtype=np.uint64)
    return (h[:-1] * np.uint64(_BASE) + h[1:]).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [pair_keys(t.split("\n")) for t in batch.column(0).to_pylist() if t]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, dtype=np.int64), *keys]), pa.int64())], names=["key"])


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row, first, key, chunk) of the pairs of neighbouring lines; row is the hash of the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            ids, row, first, key, body = [], [], [], [], []
            for d, x, t in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                lines = (t or "").split("\n")
                n = len(lines) - 1
                ids += [d] * n
                row += [x] * n
                first += range(n)
                key += pair_keys(lines).tolist()
                body += [f"{a}\n{b}" for a, b in zip(lines, lines[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(row, pa.int64()), pa.array(first, pa.int32()), pa.array(key, pa.int64()), pa.array(body, pa.string())], names=["doc_id", "row", "first", "key", "chunk"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for d, t, gone in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                lines = (t or "").split("\n")
                parts = chunks(lines) if t else []
                out, stay = set(), set()
                for g in gone or []:
                    (stay if g["stays"] else out).update((g["first"], g["first"] + 1))
                out -= stay
                lost = sum(any(i in out for i in range(a, b)) for a, b in parts) if out else 0
                clean = t if not out else "\n".join(x for i, x in enumerate(lines) if i not in out)
                rows.append((d, len(lines) if t else 0, len(parts), lost, len(out), len(t or "") - len(clean or ""), clean))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], names=["doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", "removed_chars", "text"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS, broadcast_docs: int = BROADCAST_DOCS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_chunks, removed_chunks, removed_lines, removed_chars, text (what stays)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    keys = base.select("text").mapInArrow(_count, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = cut(keys, "lines-keys")
    few = keys.limit(broadcast_keys + 1).count() <= broadcast_keys
    listed = base.mapInArrow(_list, "doc_id long, row long, first int, key long, chunk string")
    again = cut(listed.join(F.broadcast(keys) if few else keys, "key", "left_semi"), "lines-repeats")
    # as a table of its own it leaves both sides of the join plain exchanges, which can be split when one key is everywhere
    where = F.struct("doc_id", "row", "first")
    kept = cut(again.groupBy("key").agg(F.min_by("chunk", where).alias("original"), F.min(where).alias("at")), "lines-kept")
    stays = F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("row") == F.col("at.row")) & (F.col("first") == F.col("at.first"))
    equal = again.join(kept, "key").where(F.col("chunk") == F.col("original")).select("doc_id", "row", "first", stays.alias("stays"))
    lists = equal.distinct().groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("first", "stays"))).alias("gone")).where(F.exists("gone", lambda g: ~g["stays"]))
    lists = cut(lists, "lines-gone").withColumnRenamed("doc_id", "gone_id").withColumnRenamed("row", "gone_row")
    small = lists.limit(broadcast_docs + 1).count() <= broadcast_docs
    out = base.join(F.broadcast(lists) if small else lists, base["doc_id"].eqNullSafe(lists["gone_id"]) & (base["row"] == lists["gone_row"]), "left").select("doc_id", "text", "gone")
    return out.mapInArrow(_apply, "doc_id long, n_lines long, n_chunks long, removed_chunks long, removed_lines long, removed_chars long, text string")
