"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

A window is a word with its borders (longer words give several), compressed once with each dictionary. zstandard finds no
match in the last bytes of its input and stores what it can't shorten, so every window is followed by a frame that both
dictionaries hold; it costs the same on both sides. A window thus has three lengths: its own, with the ordinary dictionary and
with the toxic one. Thresholds on them are calibrated, on documents that neither dictionary was trained on (two folds): for
each triple, the share of toxic documents among those that have such a window; a triple is telling from a share of TELLING
on. A document is judged by its most telling window: its score is the share of toxic documents among those with the same best
triple and, like it, with or without a second telling word.

The toxic dictionary is trained on toxic documents reduced to their typical words (at least MIN_DOCS toxic documents have
them, RATIO times more often than ordinary ones); else its few kilobytes would go to what both kinds of text have in common.

Training takes at most SAMPLE labelled documents of at most LONGEST characters, those of the smallest hashes of their ids, to
the driver; scoring reads every whole text. Labels, language, source and id are no inputs of a score.

Cases: null and empty texts have no window and get the share of toxic documents among those without a telling window. Without
labels of both kinds every score is the share of toxic labels (0 without labels). A repeated label counts as toxic if any
says so. Rows are returned one for one; a null id is scored and is not held out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents for training, and the longest of them in characters.
SAMPLE, LONGEST = 6000, 60_000
#: Bytes of the dictionaries; compression level.
TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 8192, 110_000, 6
#: When a word is typical of toxic documents.
MIN_DOCS, RATIO = 3, 8.0
#: Characters of a window at most; longer words are cut into windows that overlap by half.
WINDOW = 32
#: Weight, in documents, of the overall share of toxic ones when that of a triple of lengths is estimated.
PRIOR = 4.0
#: Least share of toxic documents of a telling triple.
TELLING = 0.3
#: Words that a worker remembers.
MEMO = 200_000

#: Bytes that occur in no UTF-8 text in this order; the frame behind each window.
FRAME = bytes(range(128, 192))
#: Bytes of a window, as they are and compressed with the ordinary and with the toxic dictionary.
Lengths = tuple[int, int, int]
_word = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_word.findall((text or "").lower()))


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    #: of telling triples
    share: dict[Lengths, float] = field(default_factory=dict)
    #: by (best triple, whether another word is telling)
    final: dict[tuple[Lengths, bool], float] = field(default_factory=dict)
    base: float = 0.0

    def __post_init__(self):
        self._open = None
        self._known: dict[tuple[Lengths, ...], tuple[Lengths, ...]] = {}
        self._memo: dict[str, Lengths | None] = {}

    def __getstate__(self):
        return (self.toxic, self.ordinary, self.share, self.final, self.base)

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.share, self.final, self.base = state
        self.__post_init__()

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(FRAME + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def lengths(self, window: str) -> Lengths:
        if self._open is None:
            self._open = (self._compressor(self.ordinary), self._compressor(self.toxic))
        b = f" {window} ".encode("utf-8", "replace") + FRAME
        return len(b) - len(FRAME), len(self._open[0].compress(b)), len(self._open[1].compress(b))

    def triples(self, word: str) -> tuple[Lengths, ...]:
        if len(word) <= WINDOW:
            out: tuple[Lengths, ...] = (self.lengths(word),)
        else:
            half = WINDOW // 2
            out = tuple({self.lengths(word[i : i + WINDOW]) for i in range(0, len(word) - half, half)})
        return self._known.setdefault(out, out)  # few differ; each is held once

    def best(self, triples: tuple[Lengths, ...]) -> Lengths | None:
        return max((p for p in triples if p in self.share), key=lambda p: (self.share[p], p), default=None)

    def verdict(self, found: list[Lengths]) -> float:
        """found: the best telling triple of each word that has one."""
        if not found:
            return self.base
        top = max(found, key=lambda p: (self.share[p], p))
        return self.final.get((top, len(found) > 1), self.share[top])

    def score(self, text: str | None) -> float:
        if not self.share:
            return self.base
        found, memo = [], self._memo
        for w in words(text):
            if w in memo:
                p = memo[w]
            else:
                p = self.best(self.triples(w))
                if len(memo) >= MEMO:
                    memo.clear()
                if len(w) <= 64:
                    memo[w] = p
            if p is not None:
                found.append(p)
        return self.verdict(found)


def _dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> tuple[bytes, bytes]:
    """Of documents as lists of words, without repeats of a document."""
    dt, do = Counter(), Counter()
    for d in toxic:
        dt.update(set(d))
    for d in ordinary:
        do.update(set(d))
    typical = {w for w, n in dt.items() if n >= MIN_DOCS and n / len(toxic) >= RATIO * (do[w] + 0.5) / len(ordinary)}

    def trained(samples: list[bytes], size: int, k: int) -> bytes:
        samples = [s for s in samples if len(s) >= 16]
        try:
            return zstandard.train_dictionary(size, samples, k=k, d=6, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
            return b"".join(dict.fromkeys(samples))[-size:]

    sample = lambda ws: (" " + " ".join(ws) + " ").encode("utf-8", "replace")
    return trained([sample([w for w in d if w in typical]) for d in toxic], TOXIC_BYTES, 16), trained([sample(d)[:4096] for d in ordinary], ORDINARY_BYTES, 24)


def train(rows: list[tuple[str, int]]) -> Model:
    """rows: (text, 1 if toxic else 0), in an order that doesn't depend on the run; they are used up, to hold texts once only."""
    seen: dict[str, int] = {}
    for text, label in rows:
        seen.setdefault(text, label)
    rows.clear()
    docs = {1: [], 0: []}
    known: dict[str, str] = {}  # each word once in memory
    while seen:
        text, label = seen.popitem()
        docs[1 if label else 0].append([known.setdefault(w, w) for w in _word.findall(text.lower())])
    del known
    n1, n0 = len(docs[1]), len(docs[0])
    if min(n1, n0) < 2:
        return Model(base=n1 / max(1, n1 + n0))
    have: dict[Lengths, list[int]] = defaultdict(lambda: [0, 0])
    held: list[tuple[int, list[tuple]]] = []
    for fold in (0, 1):
        m = Model(*_dictionaries(docs[1][fold::2], docs[0][fold::2]))
        memo: dict[str, tuple] = {}
        for label in (0, 1):
            for d in docs[label][1 - fold :: 2]:
                own = [memo[w] if w in memo else memo.setdefault(w, m.triples(w)) for w in dict.fromkeys(d)]
                held.append((label, own))
                for p in set().union(*own):
                    have[p][label] += 1
    overall = n1 / (n1 + n0)
    share = {p: (t + PRIOR * overall) / (o + t + PRIOR) for p, (o, t) in have.items()}
    out = Model(*_dictionaries(docs[1], docs[0]), {p: s for p, s in share.items() if s >= TELLING})
    seen_as: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for label, own in held:
        found = [p for p in map(out.best, own) if p is not None]
        seen_as[(max(found, key=lambda p: (share[p], p)), len(found) > 1) if found else None][label] += 1
    none = seen_as.pop(None, [0, 0])
    out.final = {k: (t + PRIOR * share[k[0]]) / (o + t + PRIOR) for k, (o, t) in seen_as.items()}
    out.base = min(0.49, (none[1] + overall) / (sum(none) + 1))
    return out


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trains on a bounded sample of the labelled documents that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    chosen = {r.doc_id: r.toxic for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toLocalIterator()}
    if not chosen:
        return Model()
    ids = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in chosen], "__id long"))
    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).where(F.length("__text") <= LONGEST).join(ids, "__id", "left_semi")
    rows = [(t, chosen[i]) for i, t in zip(*(text.toArrow().column(c).to_pylist() for c in ("__id", "__text")), strict=True)]
    rows.sort(key=lambda x: (hash_text(x[0]), x[1]))
    return train(rows)


def hash_text(text: str) -> bytes:
    import hashlib

    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = [model.score(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not scored as toxic, with their columns; texts pass through once and are not joined."""
    fields = docs.columns
    at = fields.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part.filter(pa.array([model.score(t) < 0.5 for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
