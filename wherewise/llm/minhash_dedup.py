"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, connected components.

1. Each text becomes its set of 5-word shingles (64-bit hashes), a signature of PERMUTATIONS minima of multiply-add hashes
   (its BANDS parts are the band keys) and a 128-bit digest of the set. Only these narrow rows go on; texts with equal sets form a class, whose
   smallest id stands for it from here on.
2. Each bucket (band, key) links its members to its smallest one: linear in the bucket, never all pairs. Pairs whose
   signatures agree too little are dropped (the floor is so low that a pair at the threshold is lost with odds below
   1e-9), the rest are confirmed on full sets.
3. Components of the confirmed links. Buckets that still hold several components are compared exactly between components,
   block against block of about BLOCK members: first by signatures, which leaves the members that have a likely partner in another
   component, then these on full sets, as products of 0/1 matrices; a block pair returns a spanning forest of its links, so
   no link that would join components is lost however large a bucket is, and no group meets in one task.
4. Components again, by large-star and small-star.

The threshold is a parameter. A pair at 0.85 shares no band with odds (1 - 0.85^4)^20 = 4e-7, a pair at 0.8 with 3e-5.

Cases: null and blank texts have an empty set and are linked with nothing. Rows with a null id are returned with a null
component, kept. Rows that repeat an id count as one document with all their links. Ties don't arise: the smallest id wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, free_names, salted_join, scratch, sift
from .components import components
from .shingles import shingle_sets

#: Words of a shingle; minima of a signature; bands of ROWS minima each.
WORDS, BANDS, ROWS = 5, 20, 4
PERMUTATIONS = BANDS * ROWS
#: Links: 100 * |intersection| >= percent * |union|; this is the default.
PERCENT = 85
#: Least number of equal minima of a candidate (of 80; a pair at 0.85 has 68 on average, 3.2 standard deviation), for PERCENT.
SIGNATURE_FLOOR = 44
#: Members of a block, about, in the exact comparison between components.
BLOCK = 384
#: Ids whose texts or signatures are read again, and buckets of several documents, are broadcast up to so many, and beyond it a filter of bits.
BROADCAST_IDS, BROADCAST_BUCKETS = 1_000_000, 500_000
#: Links of a hot centre are confirmed in groups of about so many.
GROUP = 256

_draw = np.random.default_rng(20240607)
_A = _draw.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """PERMUTATIONS minima (upper 32 bits of a * x + b modulo 2**64) of each non-empty set."""
    out = np.empty((len(sets), PERMUTATIONS), dtype=np.uint64)
    lo = 0
    while lo < len(sets):  # as many sets at once as stay in the processor's cache
        hi, held = lo, 0
        while hi < len(sets) and (hi == lo or held + len(sets[hi]) <= 32768):
            held += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        v = np.empty_like(x)
        for i in range(PERMUTATIONS):
            np.multiply(x, _A[i], out=v)
            v += _B[i]
            out[lo:hi, i] = np.minimum.reduceat(v, starts)
        lo = hi
    return (out >> np.uint64(32)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("sig", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = list(shingle_sets(part.column(1).to_pylist(), WORDS))
            full = [i for i, s in enumerate(sets) if len(s)]
            cls: list = [None] * len(sets)
            sig: list = [None] * len(sets)
            if full:
                minima = signature([sets[i] for i in full])
                for row, i in zip(minima, full, strict=True):
                    cls[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], schema=schema)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_sketch, "doc_id long, n_shingles long, cls binary, sig binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), WORDS)], pa.binary())], names=["doc_id", "shingles"])


def _linked(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _confirm_star(group: dict[str, list], percent: int) -> list[tuple]:
    """Members of a group against its centre, on full sets; an id may have several."""
    sets = [(d, np.frombuffer(s, dtype=np.uint64)) for d, s in zip(group["doc_id"], group["shingles"], strict=True)]
    centre = group["centre"][0]
    mine = [s for d, s in sets if d == centre]
    return [(centre, d) for d, s in sets if d != centre and any(_linked(len(np.intersect1d(m, s, assume_unique=True)), len(m), len(s), percent) for m in mine)]


def members(group: dict[str, list], *wanted: str) -> tuple:
    """The ids of a group, their components and the wanted columns; an id has a row for each of its sets."""
    return np.array(group["doc_id"], dtype=np.int64), np.array(group["component"], dtype=np.int64), *(group[c] for c in wanted)


def survivors(group: dict[str, list], ids: np.ndarray, comp: np.ndarray, stays: np.ndarray) -> list[tuple]:
    """Rows (band, key, i, j, doc_id, component) of the members of a pair of blocks that stay."""
    head = tuple(group[c][0] for c in ("band", "key", "i", "j"))
    return sorted({(*head, int(ids[k]), int(comp[k])) for k in np.flatnonzero(stays)})


SURVIVORS = "band int, key long, i int, j int, doc_id long, component long"


def _likely(group: dict[str, list], floor: int) -> list[tuple]:
    """The members of a pair of blocks that have at least floor equal minima with a member of another component and share no earlier band with
    it: a pair that does meets there too (or is all of that bucket, and then it was compared with its centre), so it counts once."""
    ids, comp, sigs = members(group, "sig")
    sig = np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(len(ids), PERMUTATIONS)
    stays = np.zeros(len(ids), dtype=bool)
    for lo in range(0, len(ids), 256):
        equal = np.zeros((len(ids[lo : lo + 256]), len(ids)), dtype=np.uint8)
        earlier = np.zeros(equal.shape, dtype=bool)
        for band in range(BANDS):
            part = np.zeros_like(equal)
            for i in range(band * ROWS, (band + 1) * ROWS):
                part += sig[lo : lo + 256, i, None] == sig[None, :, i]
            equal += part
            if band < group["band"][0]:
                earlier |= part == ROWS
        stays[lo : lo + 256] = ((equal >= floor) & ~earlier & (comp[lo : lo + 256, None] != comp[None, :])).any(axis=1)
    return survivors(group, ids, comp, stays)


def confirm_block(group: dict[str, list], percent: int, kind: type = np.uint64) -> list[tuple]:
    """All members of one block against all of another (or of the same), between components; a spanning forest of what is linked."""
    ids, comp, texts = members(group, "shingles")
    sets = [np.frombuffer(s, dtype=kind) for s in texts]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    n = len(ids)
    row = np.repeat(np.arange(n), size)
    x, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)  # what only one member has can't add to an intersection
    place = np.full(len(x), -1, dtype=np.int64)
    place[common] = np.arange(len(common))
    col = place[inverse]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, len(common), 4096):
        i, j = np.searchsorted(col, [lo, lo + 4096])
        m = np.zeros((n, min(4096, len(common) - lo)), dtype=np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        inter += m @ m.T
    found = _linked(inter.astype(np.int64), size[:, None], size[None, :], percent) & (comp[:, None] != comp[None, :])
    parent = {c: c for c in set(comp.tolist())}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(found, 1)), strict=True):
        p, q = root(comp[i]), root(comp[j])
        if p != q:
            parent[p] = q
            out.append((int(ids[i]), int(ids[j])))
    return out


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int, floor: int) -> DataFrame:
    sk = cut(sketches(docs, id_col, text_col), "minhash-sketch")
    known = sk.where("cls is not null and doc_id is not null").select("doc_id", "cls")
    rep = cut(known.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "minhash-classes")
    member = salted_join(known, rep.where("n > 1"), ["cls"], "doc_id").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    # one row per class: that of its smallest id
    reps = sk.select("doc_id", "cls", "sig").join(rep.select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"]).dropDuplicates(["cls", "doc_id"])
    reps = cut(reps.drop("cls"), "minhash-reps")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    entries = cut(reps.select("doc_id", F.posexplode(bands).alias("band", "key")), "minhash-entries")
    buckets = cut(entries.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("centre")).where("n > 1"), "minhash-counts")
    # most keys are one document's; those entries, and the signatures of documents that share no bucket, are left where they are
    shared = cut(sift(entries, buckets.select("band", "key"), ["band", "key"], BROADCAST_BUCKETS), "minhash-shared")
    full = cut(salted_join(shared, buckets, ["band", "key"], "doc_id"), "minhash-buckets")
    met = cut(full.select("doc_id").distinct(), "minhash-met")
    sigs = cut(sift(reps, met, ["doc_id"], BROADCAST_IDS), "minhash-signatures")

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def with_sets(ids: DataFrame) -> DataFrame:
        """(doc_id, shingles) of the given class representatives; texts are read again, as shingles take more room than words."""
        ids = cut(ids.distinct(), "minhash-ids")
        sets = cut(sift(text, ids, ["doc_id"], BROADCAST_IDS).mapInArrow(_sets, "doc_id long, shingles binary"), "minhash-sets")
        # one shuffle serves for repeated rows and for the join behind
        return sets.repartition("doc_id").dropDuplicates(["doc_id", "shingles"])

    # signature verification of bucket members against the bucket's centre
    pairs = cut(full.where("doc_id <> centre").select("centre", "doc_id").distinct().join(sigs.select("doc_id", F.col("sig").alias("s")), "doc_id"), "minhash-stars")
    centres = pairs.groupBy("centre").agg(F.count("*").alias("n")).join(sigs.select(F.col("doc_id").alias("centre"), F.col("sig").alias("c")), "centre")
    both = salted_join(pairs, cut(centres, "minhash-centres"), ["centre"], "doc_id")
    near = cut(both.where(agreement("s", "c") >= floor).select("centre", "doc_id"), "minhash-pairs")

    spread = near.groupBy("centre").agg(F.count("*").alias("n"))
    cell = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / GROUP)).cast("int")
    stars = near.join(spread, "centre").select("centre", cell.alias("cell"), "doc_id")
    grouped = stars.union(stars.select("centre", "cell", F.col("centre").alias("doc_id")).distinct())
    sets = with_sets(near.select("doc_id").union(near.select("centre")))
    edges = cut(by_group(grouped.join(sets, "doc_id"), ["centre", "cell"], lambda g: _confirm_star(g, percent), "a long, b long"), "minhash-links")
    first = components(edges)

    left = open_lists(full.select("band", "key", "doc_id"), first)
    blocks = block_pairs(left).join(sigs.select("doc_id", "sig"), "doc_id")
    pair = ["band", "key", "i", "j"]
    likely = cut(by_group(blocks, pair, lambda g: _likely(g, floor), SURVIVORS), "minhash-likely")
    sets2 = with_sets(likely.select("doc_id"))
    more = by_group(likely.join(sets2, "doc_id"), pair, lambda g: confirm_block(g, percent), "a long, b long")
    last = components(edges.union(more).union(member))

    out = sk.select("doc_id", "n_shingles").join(last.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, floor: int = SIGNATURE_FLOOR) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id). Links are pairs of percent / 100 or more;
    candidates need at least floor equal minima."""
    with scratch(docs.sparkSession):
        return cut(_components(docs, id_col, text_col, percent, floor), "minhash-components", keep=True)


def open_lists(listed: DataFrame, first: DataFrame) -> DataFrame:
    """Of distinct rows (band, key, doc_id) those of lists whose members are in several components (id, component), with component, and of the
    list n, main (the component with most members) and in (how many)."""
    label = cut(listed.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "minhash-labels")
    mark = [F.sum(F.xxhash64("doc_id", F.lit(i)).cast("decimal(20,0)")).alias(f"mark{i}") for i in (0, 1)]
    parts = label.groupBy("band", "key", "component").agg(F.count("*").alias("m"), *mark)
    main = F.max(F.struct("m", "component"))
    open_ = parts.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("m").alias("n"), main["component"].alias("main"), main["m"].alias("in"), F.sum("mark0").alias("mark0"), F.sum("mark1").alias("mark1")).where("parts > 1 and n > 2")
    # the same members often share several buckets: one of them is enough
    one = open_.groupBy("n", "mark0", "mark1").agg(F.min(F.struct("band", "key", "main", "in")).alias("b")).select("n", "b.*")
    return cut(salted_join(label, cut(one, "minhash-open-buckets"), ["band", "key"], "doc_id"), "minhash-open")


def agreement(a: str, b: str):
    """Number of equal minima of two signatures (4 bytes each)."""
    at = F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1))
    return F.size(F.filter(at, lambda i: F.substring(F.col(a), i * 4 + 1, F.lit(4)) == F.substring(F.col(b), i * 4 + 1, F.lit(4))))


def block_pairs(left: DataFrame, size: int = BLOCK) -> DataFrame:
    """Block pairs (i, j) of open buckets: members outside the largest component (blocks 0 ... u-1) against each other and against that
    component's (blocks u ...). The largest component is never compared with itself."""
    u, v = F.ceil((F.col("n") - F.col("in")) / size).cast("int"), F.ceil(F.col("in") / size).cast("int")
    own = F.when(F.col("component") != F.col("main"), F.pmod(F.xxhash64("doc_id"), u).cast("int")).otherwise(u + F.pmod(F.xxhash64("doc_id"), v).cast("int"))
    x = left.select("band", "key", "doc_id", "component", own.alias("own"), u.alias("u"), v.alias("v"))
    # a block outside meets every block once; one of the largest component meets those outside
    others = F.when(F.col("own") < F.col("u"), F.sequence(F.lit(0), F.col("u") + F.col("v") - 1)).otherwise(F.sequence(F.lit(0), F.col("u") - 1))
    x = x.select("band", "key", "doc_id", "component", "own", F.explode(others).alias("other"))
    return x.select("band", "key", "doc_id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def near_dedup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, floor: int = SIGNATURE_FLOOR) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: of each component the document with the smallest id. Rows with a null id stay."""
    (name,) = free_names(docs, "gone")
    gone = minhash_components(docs, id_col, text_col, percent, floor).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    gone = cut(gone, "minhash-gone")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
