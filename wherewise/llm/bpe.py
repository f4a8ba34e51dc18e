"""Byte-level BPE in linear time, with the ids of a rank file, and back.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over all tokens can run on them. Of a piece it gives the longest
token at every place. The encoder goes left to right with the longest token, falls back to the next shorter prefix token when
the last token and this one could not stand side by side, and steps back over places from which no ending was found; each
place is left at most once, so the time is linear. Whether two tokens can stand side by side depends on these two only: it is
decided by undoing their last merges by rank until a merge across the border would have come first, and remembered.

Cases: a null text is an empty one (no ids, digest of nothing). Pieces are matches of the pattern; characters outside all
matches, if the pattern leaves any, are not encoded. Lone surrogates can't occur in Spark strings. Rows are returned one for
one, with repeats and ties as they are; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers (about 300 bytes each), and pairs of tokens (about 150); when full, all are forgotten.
MEMO, PAIRS = 300_000, 100_000
#: Characters of a piece beyond which it is not remembered.
LONG_PIECE = 200


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.digits_of = {i: str(i) for i in self.bytes_of}
        self.halves: dict[int, tuple[int, int]] = {}
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1:
                parts = self._merged(b, i)
                if len(parts) == 2:
                    self.halves[i] = (parts[0], parts[1])
        # tokens that merges never build are no candidates (a piece that equals one still gets its id, below)
        self.built = {b for b, i in ranks.items() if len(b) == 1 or i in self.halves}
        self.pair_of = {h: i for i, h in self.halves.items()}
        automaton = ahocorasick.Automaton()
        for b in self.built:
            automaton.add_word(b.decode("latin-1"), (len(b), ranks[b]))
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter: dict[int, int] = {}  # the longest token that is a proper prefix
        for b in self.built:
            for n in range(len(b) - 1, 0, -1):
                if b[:n] in self.built:
                    self.shorter[ranks[b]] = ranks[b[:n]]
                    break
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def _merged(self, b: bytes, below: int) -> list[int]:
        """Parts of b after all merges of a rank under below, lowest first."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(x + y, below), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves left and right side by side when their bytes follow each other."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = len(self.bytes_of) + 1 << 1
        while True:
            across = self.pair_of.get((left, right))
            if across is not None and across < limit:
                return False  # this merge across the border would have come first
            if left > right:  # left was built later: undo it, keep the half at the border
                limit = left
                if left not in self.halves:
                    if right not in self.halves:
                        return True
                    limit, right = right + 1, self.halves[right][0]
                else:
                    left = self.halves[left][1]
            else:
                limit = right + 1  # a tie is won by the place further left
                if right not in self.halves:
                    if left not in self.halves:
                        return True
                    limit, left = left, self.halves[left][1]
                else:
                    right = self.halves[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest: list[int] = [-1] * len(piece)
        best = [0] * len(piece)
        for end, (n, token) in self.automaton.iter(piece.decode("latin-1")):
            start = end - n + 1
            if n > best[start]:
                best[start], longest[start] = n, token
        out: list[int] = []
        at, dead = 0, set()
        token = longest[0]
        while at < len(piece):
            last = out[-1] if out else None
            while token is not None and ((at + self.length[token]) in dead or (last is not None and not self.compatible(last, token))):
                token = self.shorter.get(token)
            if token is not None:
                out.append(token)
                at += self.length[token]
                token = longest[at] if at < len(piece) else None
            else:  # no way on from here: never come back, and take less before it
                dead.add(at)
                token = out.pop()
                at -= self.length[token]
        return out

    def encode(self, text: str, pattern: regex.Pattern) -> list[int]:
        memo = self.memo
        pieces = pattern.findall(text)
        try:
            return list(chain.from_iterable([memo[p] for p in pieces]))
        except KeyError:
            if len(memo) >= MEMO:
                memo.clear()
            once: dict[str, tuple[int, ...]] = {}  # long pieces hardly come again
            for p in pieces:
                if p not in memo and p not in once:
                    (memo if len(p) <= LONG_PIECE else once)[p] = tuple(self.encode_piece(p.encode()))
            return list(chain.from_iterable([memo[p] if p in memo else once[p] for p in pieces]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_open: dict[tuple[str, str], tuple[Bpe, regex.Pattern]] = {}


def tokenizer(path: str, pattern: str) -> tuple[Bpe, regex.Pattern]:
    """One for each file and pattern in each worker."""
    if (path, pattern) not in _open:
        _open[path, pattern] = (Bpe(read_ranks(path)), regex.compile(pattern))
    return _open[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256: each text encoded, and its ids decoded again."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else []), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, compiled = tokenizer(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, ids, sha, back = [], [], [], []
                for text in part.column(1).to_pylist():
                    own = bpe.encode(text or "", compiled)
                    n.append(len(own))
                    if with_ids:
                        ids.append(own)
                    sha.append(hashlib.sha256(",".join(map(bpe.digits_of.__getitem__, own)).encode()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                cols = [part.column(0), pa.array(n, pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), pa.array(sha), pa.array(back)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
