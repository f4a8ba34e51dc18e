"""SpotSigs fingerprints: chains of content words that follow common-word anchors, and the texts that they show to be near copies.

Each common word of a text is an anchor; with the CHAIN content words (words that aren't common) that follow it, it forms a
spot signature. A fingerprint is the set of a text's signatures (32-bit hashes); the likeness of two is their Jaccard index.

Near copies (near_classes): sets are partitioned by length so that sets of likeness TAU or more fall into the same or neighbouring
partitions, and indexed there by their rarest signatures: two such sets share one of the first |s| - ceil(TAU |s|) + 1 of both, in any order
of signatures. Rare ones come first by the counts of CELLS cells of hashes, over all sets. Each list of the index is compared with its
smallest member, and where it then holds several components these are compared with each other, block by block. A comparison is given up
as soon as lengths, or the parities of the sets' hashes, rule out the likeness asked for.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, with A-Z lower-cased. A text without a full chain takes
every word as an anchor, with what follows it; so only a text without words has an empty fingerprint, and two such are alike.

Neighbours in order of id come from one shuffle into ranges of ids, of texts compressed one by one. Bounds are ids (with a hash of the text)
of a sample of about SPREAD rows a range, picked by hash; they shape the ranges and not the result. The row at each bound is also dealt to the
next range, whose last row it follows, so no row waits for another task and no task sees more than its range.

Cases: a null text is an empty one. The document after the last is the first; a single document is its own neighbour. Rows of
equal ids stand in order of a hash of their texts; null ids come last. Rows that are alike in id and text share a range. Texts without words
are near copies of nothing. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, release, salted_join, scratch, text_of
from .components import components
from .minhash_dedup import SURVIVORS, block_pairs, confirm_block, members, open_lists, survivors
from .shingles import mix, word_hashes

# fixed values: common words of English, German, French and Spanish
COMMON = (
    "a an and are as at be by for from had has have he her his i in is it not of on or she that the they this to was we were which will with you "
    "als am auch auf aus bei das dem den der des die ein eine einem einen er es für hat ich im in ist mit nicht sich sie sind so und vom von war wie zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les mais ne nous on ou par pas pour qui que sa se ses son sont sur un une vous "
    "al como con del el ella en es esta fue ha la las lo los más no o para pero por que se sin sobre su sus un una y"
).split()
#: Content words of a chain; the likeness of near copies, which partitions by length are made for.
CHAIN, TAU = 2, 0.8
#: Documents of a range of ids, about; most ranges; rows sampled for each.
RANGE, MOST_RANGES, SPREAD = 1024, 20_000, 20
#: Cells of hashes by whose counts signatures are ordered; members of a block, about, when a list is compared between components.
CELLS, BLOCK = 1 << 16, 256
#: Keys that are broadcast at most.
BROADCAST_KEYS = 1_000_000

_U = np.uint64
_split = np.ones(256, dtype=bool)
_split[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _common_hashes() -> np.ndarray:
    return np.unique(word_hashes([w.encode() for w in COMMON], _split)[0])


_common = _common_hashes()


def signatures(texts: list[str]) -> list[np.ndarray]:
    """The sorted set of signatures (32-bit) of each text."""
    words, counts = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts], _split)
    n = len(words)
    doc = np.repeat(np.arange(len(texts)), counts)
    common = _common[np.minimum(np.searchsorted(_common, words), len(_common) - 1)] == words
    content = np.flatnonzero(~common)
    before = np.cumsum(~common) - ~common  # content words before each word
    at = np.flatnonzero(common)
    first = before[at]
    full = first + CHAIN <= len(content)
    at, first = at[full], first[full]
    last = content[first + CHAIN - 1] if len(first) else first
    same = doc[last] == doc[at] if len(first) else np.zeros(0, dtype=bool)
    at, first = at[same], first[same]
    chain = words[at]
    for i in range(CHAIN):
        chain = mix(chain * _U(0xD6E8FEB86659FD93) + words[content[first + i]])
    owner = doc[at]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    starts = np.concatenate([[0], np.cumsum(counts)]) if len(counts) else np.zeros(1, dtype=np.int64)
    out = []
    for i in range(len(texts)):
        own = chain[bounds[i] : bounds[i + 1]]
        if not len(own) and counts[i]:
            w = words[starts[i] : starts[i + 1]]
            own = w.copy()
            for k in range(1, CHAIN + 1):
                nxt = np.zeros_like(w)
                if k < len(w):
                    nxt[: len(w) - k] = w[k:]
                own = mix(own * _U(0xD6E8FEB86659FD93) + nxt)
        out.append(np.unique((own >> _U(32)).astype(np.uint32)))
    return out


def partition(size: int, tau: float = TAU) -> int:
    """Sets of likeness tau or more are in the same or neighbouring partitions."""
    return int(np.floor(np.log(size) / -np.log(tau) + 1e-9)) + 1 if size else 0


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0, tau: float = TAU) -> float:
    """Of two sorted sets; 0 as soon as lengths rule out a likeness of `least`."""
    if not len(a) and not len(b):
        return 1.0
    if least >= tau and abs(partition(len(a), tau) - partition(len(b), tau)) > 1:
        return 0.0
    small, large = sorted((len(a), len(b)))
    if small < least * large or not small:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def _hex(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about half a megabyte of text each."""
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        size += n or 0
        if size > 1 << 19:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), size, cls (a number for the set, of 64 bits; null for the empty one), bits (see parity), sigs (signatures, 4 bytes each)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("size", pa.int32()), ("cls", pa.int64()), ("bits", pa.binary()), ("sigs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                sets = signatures(part.column(2).to_pylist())
                cls = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(cls, pa.int64()), pa.array([parity(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return _base(docs, id_col, text_col).mapInArrow(run, "doc_id long, row long, size int, cls long, bits binary, sigs binary")


def parity(sigs: np.ndarray) -> bytes:
    """For each class of hashes whether the set has an odd number of them; at least 64 bits, and two a signature. Two sets differ in at least as
    many signatures as their parities differ in bits, which rules out most unlike pairs and no like ones."""
    bits = max(64, 1 << (2 * len(sigs) - 1).bit_length()) if len(sigs) else 64
    return np.packbits(np.bincount(sigs.astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ, the longer one folded to the length of the other."""
    least = min(len(a), len(b)) // 8
    x, y = (np.bitwise_xor.reduce(np.frombuffer(p, dtype=np.uint64).reshape(-1, least), axis=0) for p in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def may_be_alike(differ: np.ndarray, n: np.ndarray, m: np.ndarray, tau: float) -> np.ndarray:
    """Whether lengths n and m and `differ` unlike parities leave a likeness of tau possible."""
    # |x ^ y| = |x| + |y| - 2 overlap, and a likeness of tau needs an overlap of tau / (1 + tau) (|x| + |y|)
    return (differ * (1 + tau) <= (n + m) * (1 - tau) + 1e-6) & (np.minimum(n, m) >= tau * np.maximum(n, m) - 1e-9)


def _likely(group: dict[str, list], tau: float) -> list[tuple]:
    """The members of a pair of blocks that lengths and parities don't keep from a likeness of tau with a member of another component."""
    ids, comp, size, bits = members(group, "size", "bits")
    least = min(map(len, bits)) // 8
    folded = [np.bitwise_xor.reduce(np.frombuffer(b, dtype=np.uint64).reshape(-1, least), axis=0) for b in bits]
    words, size = np.array(folded), np.array(size, dtype=np.int64)
    stays = np.zeros(len(ids), dtype=bool)
    for lo in range(0, len(ids), 64):
        hi = lo + 64
        differ = np.zeros((len(ids[lo:hi]), len(ids)), dtype=np.int64)
        for w in range(least):
            differ += np.bitwise_count(words[lo:hi, w, None] ^ words[None, :, w])
        fits = may_be_alike(differ, size[lo:hi, None], size[None, :], tau)
        stays[lo:hi] = (fits & (comp[lo:hi, None] != comp[None, :])).any(axis=1)
    return survivors(group, ids, comp, stays)


def _cells(sigs: np.ndarray) -> np.ndarray:
    return (sigs.astype(np.uint32) * np.uint32(2654435769) >> np.uint32(16)).astype(np.int64) % CELLS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for s in batch.column(0).to_pylist():
            total += np.bincount(_cells(np.frombuffer(s, dtype=np.uint32)), minlength=CELLS) if len(s) > CELLS else 0
            if len(s) <= CELLS:
                np.add.at(total, _cells(np.frombuffer(s, dtype=np.uint32)), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["cell", "n"])


def first_signatures(sigs: np.ndarray, common: np.ndarray, tau: float) -> np.ndarray:
    """Those under which a set is looked for: the rarest, as many as two sets of likeness tau can't all miss."""
    n = len(sigs) - int(np.ceil(tau * len(sigs) - 1e-9)) + 1
    return sigs[np.lexsort((sigs, common[_cells(sigs)]))[:n]]


def _small(keys: DataFrame) -> DataFrame:
    """To be broadcast if there are at most BROADCAST_KEYS (8 bytes each); else joined by shuffle. A table, as it is counted."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def near_classes(rows: DataFrame, percent: int = round(100 * TAU)) -> DataFrame:
    """(cls, component): classes of equal fingerprints that have near copies, of percent or more, and the smallest class that can be reached
    from them. rows as of fingerprint_rows, cut to a table."""
    tau, spark = percent / 100, rows.sparkSession
    classes = cut(rows.where("size > 0").select(F.col("cls").alias("doc_id"), "size", "bits", "sigs").dropDuplicates(["doc_id"]), "spot-classes")
    counted = classes.select("sigs").mapInArrow(_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(CELLS, dtype=np.int64)
    common[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.frombuffer(s, dtype=np.uint32) for s in part.column(2).to_pylist()]
                keys = [first_signatures(s, common, tau) for s in sets]
                many = [len(k) for k in keys]
                size = np.repeat(part.column(1).to_numpy(), many)
                own = np.repeat(np.array([partition(len(s), tau) for s in sets], dtype=np.int32), many)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), many)), pa.array(size), pa.array(own), pa.array(np.concatenate(keys).astype(np.int64))], names=["doc_id", "size", "own", "key"])

    entries = classes.select("doc_id", "size", "sigs").mapInArrow(listed, "doc_id long, size int, own int, key long")
    shared = cut(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "spot-shared")
    entries = cut(entries.join(_small(shared), "key", "left_semi"), "spot-entries")
    # a set is listed in its own partition and in the next one, so neighbouring partitions meet
    lists = entries.select("doc_id", "size", "key", F.explode(F.array("own", F.col("own") + 1)).alias("band"))
    centres = lists.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "size")).alias("c")).where("n > 1")
    full = cut(salted_join(cut(lists, "spot-lists"), cut(centres, "spot-centres"), ["band", "key"], "doc_id"), "spot-full")
    alike = F.least("size", "c.size") >= F.greatest("size", "c.size") * tau - 1e-9
    pairs = cut(full.where((F.col("doc_id") != F.col("c.doc_id")) & alike).select(F.col("c.doc_id").alias("centre"), "doc_id").distinct(), "spot-pairs")
    release(spark)

    def sets_of(ids: DataFrame, *columns: str) -> DataFrame:
        """Of the given classes (doc_id) only; others aren't shuffled, while the ids are few enough to be broadcast."""
        return classes.select("doc_id", *columns).join(_small(cut(ids.distinct(), "spot-ids")), "doc_id", "left_semi")

    def with_both(pairs: DataFrame, *columns: str) -> DataFrame:
        """pairs (centre, doc_id; a table) with the given columns of the centre, c_ before their names, and of doc_id."""
        held = cut(sets_of(pairs.select("doc_id").union(pairs.select("centre")), *columns), "spot-sets")
        of_centre = held.select(F.col("doc_id").alias("centre"), *(F.col(c).alias(f"c_{c}") for c in columns))
        mine = pairs.groupBy("centre").agg(F.count("*").alias("n")).join(of_centre, "centre")
        both = salted_join(pairs, cut(mine, "spot-stars"), ["centre"], "doc_id").join(held, "doc_id")
        return both.select("centre", "doc_id", *(f"c_{c}" for c in columns), *columns)

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, m, b = (batch.column(i).to_pylist() for i in range(2, 6))
            differ = np.array([parity_distance(x, y) for x, y in zip(a, b, strict=True)], dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(may_be_alike(differ, np.array(n, dtype=np.int64), np.array(m, dtype=np.int64), tau), pa.bool_()))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            fits = [jaccard(np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32), tau, tau) >= tau - 1e-12 for x, y in zip(a, b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(fits, pa.bool_()))

    # parities, a tenth of a set, decide about most pairs; sets are sent for the rest only
    near = cut(with_both(pairs, "size", "bits").mapInArrow(fitting, "centre long, doc_id long"), "spot-fitting")
    edges = cut(with_both(near, "sigs").mapInArrow(confirmed, "centre long, doc_id long").toDF("a", "b"), "spot-links")
    release(spark)
    left = open_lists(full.select("band", "key", "doc_id"), components(edges))
    pair = ["band", "key", "i", "j"]
    blocks = block_pairs(left, BLOCK).join(sets_of(left.select("doc_id"), "size", "bits"), "doc_id")
    likely = cut(by_group(blocks, pair, lambda g: _likely(g, tau), SURVIVORS), "spot-likely")
    more = by_group(likely.join(sets_of(likely.select("doc_id"), "sigs").withColumnRenamed("sigs", "shingles"), "doc_id"), pair, lambda g: confirm_block(g, percent, np.uint32), "a long, b long")
    return components(edges.union(more)).withColumnRenamed("id", "cls")


def near_documents(rows: DataFrame, percent: int = round(100 * TAU)) -> DataFrame:
    """(cls, class_id, class_size): for each class of equal fingerprints the smallest id of all documents that are linked to it, and their number."""
    near = near_classes(rows, percent)
    own = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    own = cut(own.join(near, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "spot-own")
    whole = own.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    return cut(own.select("cls", "component").join(whole, "component").select("cls", "class_id", "class_size"), "spot-near")


#: Kinds of rows of a range: what is known of a row's near copies, just before it, the row, and behind all rows the guest.
NEAR, OWN, GUEST = 0, 1, 2
COLUMNS = "range int, kind int, doc_id long, row long, packed binary, class_id long, class_size long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, kind, doc_id, row, packed, class_id, class_size) sorted by range, then as documents follow each other; guests only lend their text."""
    held = None  # the last text: (range, kind, doc_id, text, class_id, class_size)
    unpack = zstandard.ZstdDecompressor().decompress

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        own = signatures([t for _, t, _, _, _ in rows])
        new = signatures([edited(t, nxt) for _, t, nxt, _, _ in rows])
        nexts = [*own[1:], None]
        for i, (_, _, nxt, _, _) in enumerate(rows):  # the next row's own fingerprint, where that is the next document
            if i + 1 >= len(rows) or rows[i + 1][1] is not nxt:
                nexts[i] = signatures([nxt])[0]
        cols = [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(edited(r[1], r[2]).encode("utf-8", "surrogatepass")).hexdigest() for r in rows]),
            pa.array([_hex(s) for s in own]), pa.array([_hex(s) for s in new]),
            pa.array([jaccard(a, b) for a, b in zip(own, new, strict=True)], pa.float64()), pa.array([jaccard(a, b) for a, b in zip(own, nexts, strict=True)], pa.float64()),
            pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=NAMES)

    rows, size, known = [], 0, None
    for batch in batches:
        for range_, kind, doc, row, packed, cls, n in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if kind == NEAR:
                known = (doc, row, cls, n)
                continue
            text = unpack(packed).decode("utf-8", "surrogatepass")
            if held is not None and held[0] == range_ and held[1] == OWN:
                rows.append((held[2], held[3], text, *held[4:]))
                size += len(held[3])
                if size > 1 << 19:
                    yield emit(rows)
                    rows, size = [], 0
            # of several guests, rows of equal id and text, the first counts, as it is no row of its own that the others could follow
            held = (range_, kind, doc, text, *(known[2:] if known and known[:2] == (doc, row) else (None, None)))
    if rows:
        yield emit(rows)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, class_size long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_range: int = RANGE, percent: int = round(100 * TAU)) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id (smallest id of the document's near
    copies, through links of percent or more; its own if there are none, null without words), class_size; one row per input row."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = cut(fingerprint_rows(docs, id_col, text_col), "spot-rows")
        near = rows.select("doc_id", "row", "cls").join(near_documents(rows, percent), "cls", "left")
        known = cut(near.select("doc_id", "row", "class_id", "class_size"), "spot-known", keep=True)
    total = known.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "row")
    ranges = max(2, min(MOST_RANGES, -(-total // per_range)))
    picked = known.select(place.alias("p")).where(F.pmod(F.xxhash64("p.k", "p.row", F.lit(7)), F.lit(max(1, total // (SPREAD * ranges)))) == 0)
    sample = sorted(set(zip(*(picked.select("p.k", "p.row").toArrow().column(c).to_pylist() for c in ("k", "row")), strict=True)))
    top = known.agg(F.max(place).alias("m")).first()["m"]
    largest = (top["k"], top["row"])
    # range i holds places in (cuts[i-1], cuts[i]]
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges) if sample} - {largest})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The largest place of range i lends its text to range i + 1, whose last row it follows; the largest of all to the first."""
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        lent = set()
        for batch in batches:
            for part in _parts(batch, 2):
                out = []
                for doc, row, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    at = (-(1 << 63) if doc is None else doc, row)
                    own = bisect.bisect_left(cuts, at)
                    packed = pack(text.encode("utf-8", "surrogatepass"))
                    out.append((own, OWN, doc, row, packed, None, None))
                    to = 0 if at == largest else own + 1 if own < len(cuts) and cuts[own] == at else None
                    if to is not None and to not in lent:
                        lent.add(to)
                        out.append((to, GUEST, doc, row, packed, None, None))
                cols = list(zip(*out, strict=True))
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    def deal_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)
            to = pa.array([bisect.bisect_left(cuts, (-(1 << 63) if d is None else d, r)) for d, r in at], pa.int32())
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([to, pa.array([NEAR] * batch.num_rows, pa.int32()), batch.column(0), batch.column(1), none, batch.column(2), batch.column(3)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    spread = _base(docs, id_col, text_col).mapInArrow(deal, COLUMNS).unionByName(known.where("class_size is not null").mapInArrow(deal_near, COLUMNS))
    order = [F.col("range"), F.col("kind") == GUEST, F.coalesce("doc_id", F.lit(-(1 << 63))).desc(), F.col("row").desc(), F.col("kind")]
    spread = spread.repartition("range").sortWithinPartitions(*order)
    return spread.mapInArrow(_pairs, SCHEMA)
