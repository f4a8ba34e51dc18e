import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wherewise.llm import exact_dedup, line_dedup, minhash_dedup
from wherewise.llm.components import components
from wherewise.llm.shingles import shingle_sets

BLANK = "[ \t\n\x0b\x0c\r]"


def brute_exact(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(BLANK, "", t or ""), []).append((i, t or ""))
    out = []
    for norm, g in groups.items():
        keep = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [0, 1000])
def test_exact_against_brute_force(make, odd, most):
    got = exact_dedup.exact_dedup(make(odd), with_digest=True, broadcast_groups=most).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(odd)


def test_exact_filter_keeps_one_of_each(make, odd):
    docs = make(odd)
    got = exact_dedup.exact_dedup_filter(docs)
    assert got.columns == docs.columns
    kept = [re.sub(BLANK, "", r["text"] or "") for r in got.collect()]
    assert sorted(kept) == sorted({re.sub(BLANK, "", t or "") for _, t, _ in odd})


def test_exact_is_the_same_beyond_every_bound(make, odd):
    rows = odd + [(100 + i, f"text {i % 40}", "s") for i in range(90)]
    every = [sorted(map(tuple, exact_dedup.exact_dedup(make(rows), broadcast_groups=most, filter_words=words).collect()), key=str) for most, words in ((10**6, 1 << 20), (0, 1 << 20), (0, 1))]
    assert every[0] == every[1] == every[2] and {r[5] for r in every[0]} == {"prefix", "full"}
    assert all((r[4] is None) == (r[5] == "prefix") for r in every[0])


def test_exact_full_hash_of_survivors_only(make):
    rows = exact_dedup.exact_dedup(make([(1, "aaa", "s"), (2, "bbbb", "s"), (3, "b bbb", "s")])).collect()
    assert {r["doc_id"]: r["level"] for r in rows} == {1: "prefix", 2: "full", 3: "full"}
    assert next(r for r in rows if r["doc_id"] == 1)["text_sha256"] is None


def test_empty_tables(make):
    none = make([])
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.exact_dedup_filter(none).count() == 0
    assert minhash_dedup.minhash_components(none).count() == 0 and minhash_dedup.near_dedup_filter(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0


def shingles(t):
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    sets = {}
    for i, t, _ in rows:
        sets.setdefault(i, []).append(shingles(t))
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted(((i, len(shingles(t)), root(i) if i is not None else None, i is None or root(i) == i) for i, t, _ in rows), key=str)


def near_rows():
    rng = random.Random(7)
    rows = []
    for g in range(12):  # chains of edits: neighbours are linked, ends need not be
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(9):
            rows.append((100 * g + k, " ".join(words), "s"))
            words = list(words)
            words[rng.randrange(len(words))] = f"e{g}k{k}"
    hot = [f"h{i}" for i in range(100)]  # one large group at all distances
    for k in range(120):
        w = list(hot)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((5000 + k, " ".join(w), "s"))
    rng.shuffle(rows)
    return rows


def test_near_against_brute_force(make, odd):
    rows = odd + near_rows()
    got = minhash_dedup.minhash_components(make(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_near(rows)


def test_near_filter(make, odd):
    docs = make(odd)
    got = minhash_dedup.near_dedup_filter(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert 1 in ids and 2 not in ids and 4 in ids and None in ids and 5 in ids and 6 in ids


def test_shingles_fold_case_and_blanks():
    a, b, c = shingle_sets(["A b\tC  d e f", "a B c\nd E f", "a b c d e"])
    assert list(a) == list(b) and len(a) == 2 and len(c) == 1
    assert [len(s) for s in shingle_sets([None, "", " \n", "one", "one two", "É é"])] == [0, 0, 0, 1, 1, 1]
    assert len({int(next(shingle_sets([t]))[0]) for t in ("one", "one two", "two one", "onetwo")}) == 4


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    assert got == {i: root(i) for i in parent if root(i) != i} | {i: root(i) for i in got if root(i) == i}
    assert set(got) >= {i for i in parent if root(i) != i}


PASSAGE = "\n".join(f"Line {i} of a passage that many documents share." for i in range(14))


def test_lines_repeated_chunks_go_once(make):
    rows = [(i, f"Own start {i}.\n{PASSAGE}\nOwn end {i}.", "s") for i in range(6)] + [(50, "One line.", "s"), (51, None, "s"), (52, "", "s")]
    for keys, docs in ((10**6, 10**6), (0, 0)):
        got = {r["doc_id"]: r for r in line_dedup.line_dedup(make(rows), broadcast_keys=keys, broadcast_docs=docs).collect()}
        assert got[0]["text"] == rows[0][1] and got[0]["removed_lines"] == 0
        for i in range(1, 6):
            assert got[i]["removed_lines"] >= 8 and got[i]["text"].startswith(f"Own start {i}.")
            assert got[i]["removed_chars"] == len(rows[i][1]) - len(got[i]["text"])
        assert (got[51]["text"], got[52]["text"], got[50]["text"]) == (None, "", "One line.")


def test_lines_boundaries_come_back_in_step():
    lines = [f"line {i} {i * 7919 % 101}" for i in range(400)]
    a = {tuple(lines[p:q]) for p, q in line_dedup.chunks(lines)}
    shifted = [*lines[:10], "inserted", *lines[10:]]
    b = {tuple(shifted[p:q]) for p, q in line_dedup.chunks(shifted)}
    assert len(a & b) > 0.9 * len(a)
    assert line_dedup.chunks([]) == [] and [q for _, q in line_dedup.chunks(lines)][-1] == 400
    assert all(2 <= q - p <= 16 for p, q in line_dedup.chunks(lines)[:-1])


def test_lines_repeated_rows_and_odd_cases(make, odd):
    got = line_dedup.line_dedup(make(odd)).collect()
    assert len(got) == len(odd)
    assert all((r["text"] or "") == (t or "") for r, (_, t, _) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["text"] or "")), sorted(odd, key=lambda x: (str(x[0]), x[1] or "")), strict=True) if r["removed_chunks"] == 0)


@pytest.mark.parametrize("most", [0, 10**6])
def test_near_against_brute_force_with_filters_of_bits_and_with_broadcast_keys(make, odd, monkeypatch, most):
    monkeypatch.setattr(minhash_dedup, "BROADCAST_IDS", most)
    monkeypatch.setattr(minhash_dedup, "BROADCAST_BUCKETS", most)
    rows = odd + near_rows()
    got = minhash_dedup.minhash_components(make(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_near(rows)


def test_a_pair_that_shares_several_buckets_is_compared_in_one():
    import numpy as np

    sig = np.arange(240, dtype=np.uint32).reshape(3, 80)
    sig[1, :8], sig[1, 12:] = sig[0, :8], sig[0, 12:]  # alike but for band 2
    sig[2, 4:8] = sig[0, 4:8]  # in the same bucket of band 1, but unlike
    likely = lambda band: [r[4] for r in minhash_dedup._likely({"doc_id": [1, 2, 3], "component": [1, 2, 3], "sig": [x.tobytes() for x in sig], "band": [band] * 3, "key": [9] * 3, "i": [0] * 3, "j": [0] * 3}, 44)]
    assert (likely(0), likely(1), likely(7)) == ([1, 2], [], [])
    sig[1, :8] += 500  # now band 3 is the first that they share
    assert (likely(0), likely(3), likely(4)) == ([1, 2], [1, 2], [])


@pytest.mark.parametrize("most, words", [(50, 1 << 10), (0, 1 << 10), (0, 1)])
def test_sift_keeps_all_that_is_wanted(spark, most, words):
    from wherewise.llm.common import sift

    df = spark.range(3000).selectExpr("cast(id % 7 as int) as band", "id as key", "'own' as word", "id as bits").union(spark.sql("select 1, null, 'own', 0"))
    wanted = spark.range(0, 3000, 100).selectExpr("cast(id % 7 as int) as band", "id as key")
    got = sift(df, wanted, ["band", "key"], most, words)
    assert sorted(got.columns) == sorted(df.columns)
    keys = [r.key for r in got.collect()]
    assert set(range(0, 3000, 100)) <= set(keys) and len(keys) == len(set(keys)) and (words == 1 or len(keys) < (31 if most else 100))
    assert sift(df, wanted.limit(0), ["band", "key"], most, words).count() == 0
