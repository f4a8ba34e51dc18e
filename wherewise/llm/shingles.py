"""Word shingles of whole texts as 64-bit hashes, computed over many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: Odd multiplier of the polynomial over bytes, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once.
CHUNK = 1 << 19

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_blank = np.zeros(256, dtype=bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, at least n of them."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=_U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=_U)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads each bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes], split: np.ndarray = _blank) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words in each text. split: by byte whether it ends a word (a line feed must)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = split[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, stop = edge[blank[edge - 1]], edge[blank[edge]]
    if len(data) and not blank[0]:
        start = np.concatenate([[0], start])
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((_lower[data].astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
    words = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(_U))
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return words, counts


def _shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    words, counts = word_hashes(texts)
    n = len(words)
    grams = np.zeros(max(0, n - k + 1), dtype=_U)
    for i in range(k):
        grams = mix(grams * _U(0xD6E8FEB86659FD93) + words[i : n - k + 1 + i]) if n >= k else grams
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(grams[at : at + c - k + 1]))
        elif c:
            h = _U(c)
            with np.errstate(over="ignore"):
                for w in words[at : at + c]:
                    h = mix(np.array([h * _U(0xD6E8FEB86659FD93) + w], dtype=_U))[0]
            out.append(np.array([h], dtype=_U))
        else:
            out.append(np.empty(0, dtype=_U))
        at += c
    return out


def shingle_sets(texts: list[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of k words; of the whole sequence if it has fewer words; none without words.

    Words are runs outside [\\x20\\x09-\\x0D], with A-Z lower-cased. Memory is bounded by CHUNK bytes and the longest text.
    """
    some: list[bytes] = []
    held = 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        if some and held + len(b) > CHUNK:
            yield from _shingles(some, k)
            some, held = [], 0
        some.append(b)
        held += len(b)
    if some:
        yield from _shingles(some, k)
