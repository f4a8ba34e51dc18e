import hashlib
import random

import numpy as np
import pytest

from wherewise.llm import bpe, mixing, spotsigs, toxicity
from wherewise.llm.queries import bpe_files

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    path, pattern = bpe_files()
    own, compiled = bpe.tokenizer(path, pattern)
    return own, compiled, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_equals_the_library(pair):
    own, compiled, library = pair
    rng = random.Random(11)
    vocabulary = [b.decode("utf-8", "ignore") for b in list(own.ranks)[::11]]
    alphabets = ["ab ", "éèàü ß", "的一是不", "\n\t  \r", "0123456789.,-", "😀🎉‍", "'s't're"]
    for i in range(4000):
        s = "".join(rng.choice(vocabulary) for _ in range(rng.randrange(7))) if i % 2 else "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(40)))
        ids = own.encode(s, compiled)
        assert ids == library.encode_ordinary(s)
        assert own.decode(ids) == s.encode()
    for s in ("a" * 20_000, "ab" * 9000, " " * 5000 + "x", "的" * 3000):
        assert own.encode(s, compiled) == library.encode_ordinary(s)


def test_bpe_when_its_memory_is_full(pair, monkeypatch):
    own, compiled, library = pair
    monkeypatch.setattr(bpe, "MEMO", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    for s in ("one two three four five six seven eight nine ten eleven", "one two three unheard wordings"):
        assert own.encode(s, compiled) == library.encode_ordinary(s)


def test_bpe_rows(make, odd, pair):
    _, _, library = pair
    got = sorted(bpe.bpe_encode(make(odd), *bpe_files()).collect(), key=str)
    want = []
    for i, t, _ in odd:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert bpe.bpe_encode(make([]), *bpe_files()).count() == 0


def neighbours(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    return [(a, order[(i + 1) % len(order)]) for i, a in enumerate(order)]


@pytest.mark.parametrize("per_range", [1, 3, 1000])
def test_spotsigs_against_brute_force(make, odd, per_range):
    got = sorted(map(tuple, spotsigs.fingerprints(make(odd), per_range=per_range).drop("class_id", "class_size").collect()), key=str)
    want = []
    for (i, t, _), (_, nxt, _) in neighbours(odd):
        t, nxt = t or "", nxt or ""
        e = spotsigs.edited(t, nxt)
        own, new, other = (spotsigs.signatures([x])[0] for x in (t, e, nxt))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), spotsigs._hex(own), spotsigs._hex(new), spotsigs.jaccard(own, new), spotsigs.jaccard(own, other)))
    assert got == sorted(want, key=str)


def test_spotsigs_small_tables(make):
    assert spotsigs.fingerprints(make([])).count() == 0
    only = spotsigs.fingerprints(make([(1, "the one and the only text of its kind", "s")])).first()
    assert only["near_next"] == 1.0


def test_spotsigs_chains_and_pruning():
    a, b = spotsigs.signatures(["the quick brown fox", "the quick brown fox"])
    assert list(a) == list(b) and len(a) == 1
    assert len(spotsigs.signatures(["no anchors here except none"])[0]) and not len(spotsigs.signatures([""])[0])
    big, small = np.arange(100, dtype=np.uint32), np.arange(10, dtype=np.uint32)
    assert spotsigs.jaccard(big, big[:85], least=0.8) == pytest.approx(0.85)
    assert spotsigs.jaccard(big, small) == pytest.approx(0.1) and spotsigs.jaccard(big, small, least=0.5) == 0.0
    for m in range(1, 200):
        for n in range(m, 200):
            if m / n >= spotsigs.TAU:
                assert abs(spotsigs.partition(m) - spotsigs.partition(n)) <= 1


def brute_spots(text):
    """Signatures as tuples of words, told from the definition."""
    import re

    words = [w.decode("utf-8", "ignore") for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    common = set(spotsigs.COMMON)
    content = [i for i, w in enumerate(words) if w not in common]
    out = set()
    for i, w in enumerate(words):
        after = [j for j in content if j > i][: spotsigs.CHAIN]
        if w in common and len(after) == spotsigs.CHAIN:
            out.add((w, *(words[j] for j in after)))
    return out or {tuple(words[i : i + 1 + spotsigs.CHAIN]) for i in range(len(words))}


def test_spotsigs_near_copies_against_brute_force(make, odd):
    rng = random.Random(12)
    vocabulary = ["the", "of", "and", "to", "in", "is", *(f"w{i}" for i in range(60))]
    rows = list(odd)
    for g in range(25):  # copies at all distances, of different lengths, and texts that share a passage only
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(6, 160))]
        for k in range(6):
            rows.append((100 + 10 * g + k, " ".join(words), "s"))
            words = list(words)
            for _ in range(rng.randrange(4)):
                words.insert(rng.randrange(len(words)), rng.choice(vocabulary)) if rng.random() < 0.5 else words.__setitem__(rng.randrange(len(words)), f"x{rng.randrange(999)}")
    shared = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows += [(1000 + i, shared + " " + " ".join(rng.choice(vocabulary) + str(rng.randrange(3)) for _ in range(80)), "s") for i in range(30)]
    got = {}
    for r in spotsigs.fingerprints(make(rows), per_range=50).collect():
        got.setdefault(r["doc_id"], set()).add((r["class_id"], r["class_size"]))
    sets = [(i, brute_spots(t)) for i, t, _ in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    want = {}
    for a, (i, x) in enumerate(sets):
        members = [j for b, (j, _) in enumerate(sets) if root(b) == root(a)]
        want.setdefault(i, set()).add((min((j for j in members if j is not None), default=None), len(members)) if x else (None, None))
    assert got == want and sum(n > 1 for v in want.values() for _, n in v if n) > 60


INSULTS = ["scoundrel", "blockhead", "numbskull", "rapscallion"]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    syllables = "ban dor fel gim hul jor kas lem mip nor".split()
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        bad = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        rows.append((" ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows():
    model = toxicity.train(toxic_rows(800, 1))
    test = toxic_rows(400, 2)
    hits = [(model.score(t) >= 0.5) == bool(y) for t, y in test]
    assert sum(hits) / len(hits) > 0.97
    assert all(0 <= model.score(t) <= 1 for t in (None, "", "x" * 10_000, "\n\n", INSULTS[0]))


def test_toxicity_rows_and_missing_labels(spark, make, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        got = toxicity.score(make(odd), toxicity.fit(make(odd), table)).collect()
        assert len(got) == len(odd) and all(r["predicted"] == (r["score"] >= 0.5) for r in got)
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    docs = make(odd)
    clean = toxicity.keep_clean(docs, toxicity.Model())
    assert clean.columns == docs.columns and clean.count() == len(odd)
    assert toxicity.score(make([]), toxicity.Model()).count() == 0


def brute_targets(sizes, share=1.5, repeat=2.0, weights=(5.0, 2.0, 1.0)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, rest, todo = {}, share * sum(sizes.values()), set(names)
    while todo:
        level = rest / sum(w[s] for s in todo)
        over = {s for s in todo if repeat * sizes[s] < level * w[s]}
        for s in over or todo:
            out[s] = repeat * sizes[s] if over else level * w[s]
        if not over:
            break
        rest -= sum(out[s] for s in over)
        todo -= over
    return out


def mix_rows():
    rng = random.Random(5)
    rows, i = [], 0
    for k in range(9):
        for _ in range(400 if k == 0 else rng.randrange(5, 60)):
            i += 1
            rows.append((i, " ".join("w" for _ in range(rng.randrange(0, 300))), None if k == 8 else f"src{k}"))
    return rows + [(9999, None, "src0"), (10000, "", "src0")]


def test_mixture_meets_targets(make):
    rows = mix_rows()
    first = mixing.mixture(make(rows), block=32, slots=64)[0].select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mixing.mixture(make(rows[::-1]), block=32, slots=64)[0].select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = brute_targets(sizes)
    taken = {}
    for r in first:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 64 + 0.02 * t, s


def test_mixture_pieces_are_what_is_taken(make, odd):
    docs = make(odd)
    rows, pieces = mixing.mixture(docs, block=4)
    assert rows.count() == len(odd)
    total = rows.agg({"taken": "sum"}).first()[0]
    assert total == sum(r["n_words"] * r["passes"] for r in pieces.collect())
    mixed = mixing.mixed_documents(docs.dropDuplicates(["doc_id", "text"]), block=4)
    assert mixed.columns == docs.columns
    assert all(len(r["text"]) == r["n_chars"] and set(r["text"].split()) <= {w for _, t, _ in odd for w in (t or "").split()} for r in mixed.collect())
    assert mixing.mixture(make([]))[0].count() == 0 and mixing.mixed_documents(make([])).count() == 0


def test_permutations_and_draws():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 12345)) == list(range(n))
    quota = np.array([500, 3, 0, 77, 1420])
    parts = list(mixing.shard_counts(quota, 20, 100, 0, 20, 9))
    assert (sum(c for _, c, _ in parts) == quota).all() and all(c.sum() == 100 for _, c, _ in parts)
    again = list(mixing.shard_counts(quota, 20, 100, 7, 9, 9))
    assert [(a, c.tolist(), b.tolist()) for a, c, b in again] == [(a, c.tolist(), b.tolist()) for a, c, b in parts[7:9]]
    before = np.zeros(5, dtype=int)
    for _, c, b in parts:
        assert (b == before).all()
        before = before + c


def test_parities_rule_out_no_near_copies():
    draw = np.random.default_rng(5)
    ruled_out = 0
    for n in [1, 2, 5, 31, 32, 33, 64, 65, 130, 700]:
        for _ in range(60):
            a = np.unique(draw.integers(0, 1 << 32, n, dtype=np.uint32))
            part = draw.random(len(a)) < draw.uniform(0.7, 1)
            b = np.unique(np.concatenate([a[part], draw.integers(0, 1 << 32, draw.integers(0, n // 4 + 1), dtype=np.uint32)]))
            if not len(b):
                continue
            differ = spotsigs.parity_distance(spotsigs.parity(a), spotsigs.parity(b))
            assert differ <= len(np.setxor1d(a, b))
            fits = bool(spotsigs.may_be_alike(np.int64(differ), np.int64(len(a)), np.int64(len(b)), 0.8))
            assert fits or spotsigs.jaccard(a, b) < 0.8
            ruled_out += not fits
    assert ruled_out
