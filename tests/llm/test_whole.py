"""Cases in which operators did less than the whole job."""

import random

import pytest

import corpus_pipeline
from wherewise.llm import exact_dedup, line_dedup, secrets

TEMPLATE = "Permission is granted to use this file under the licence below. " * 2


@pytest.mark.parametrize("most", [0, 1000])
def test_exact_filter_loses_no_text_of_shared_ids(make, most):
    texts = [TEMPLATE + f"holder {i:03}" for i in range(8)]  # equal in length and prefix
    rows = [(None, t, "s") for t in texts] + [(1, texts[0], "s"), (2, texts[3], "s"), (7, texts[5], "s"), (7, texts[6], "s"), (7, texts[6], "s"), (None, texts[7], "s")]
    rows += [(9, TEMPLATE + "holder abc", "s"), (9, TEMPLATE + "holder abd", "s"), (8, TEMPLATE + "holder abc", "s")]
    docs = make(rows)
    got = exact_dedup.exact_dedup_filter(docs, broadcast_groups=most)
    assert got.columns == docs.columns
    assert sorted(r["text"] for r in got.collect()) == sorted({t for _, t, _ in rows})


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pipeline_near_dedup_against_brute_force(spark, make):
    rng = random.Random(11)
    rows = []
    for g in range(30):  # pairs on both sides of 0.8 and of 0.85: each changed word takes five shingles of 116
        words = [f"g{g}w{i}" for i in range(120)]
        for k in range(3):
            w = list(words)
            for at in rng.sample(range(6, 114, 9), k and rng.randrange(1, 5)):
                w[at] = f"g{g}k{k}x{at}"
            rows.append((10 * g + k, " ".join(w), "s"))
    hot = [f"h{i}" for i in range(100)]  # a bucket with several components
    for k in range(60):
        w = list(hot)
        for at in rng.sample(range(100), rng.randrange(8)):
            w[at] = f"y{rng.randrange(10**6)}"
        rows.append((5000 + k, " ".join(w), "s"))
    sets = {i: shingles(t) for i, t, _ in rows}

    def first_ids(percent):
        parent = {i: i for i in sets}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
        return {i for i in sets if root(i) == i}

    got = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, make(rows), "").collect()]
    assert sorted(got) == sorted(first_ids(80)) and first_ids(80) != first_ids(85)


def test_lines_of_rows_that_share_an_id(make):
    passage = "\n".join(f"Line {i} of a passage that many documents share." for i in range(14))
    own = "\n".join(f"Unique line {i} of a row without an id." for i in range(40))
    rows = [(None, own, "s"), (None, passage, "s"), (None, f"Own start.\n{passage}\nOwn end.", "s"), (3, own.replace("Unique", "Other"), "s"), (3, f"Three.\n{passage}", "s")]
    got = {r["n_lines"]: r["text"] for r in line_dedup.line_dedup(make(rows)).collect() if r["n_lines"] in (15, 16)}
    whole = {r["text"] for r in line_dedup.line_dedup(make(rows)).collect()}
    assert own in whole and own.replace("Unique", "Other") in whole
    texts = [*got.values(), *(t for t in whole if t.startswith("Line 0"))]
    assert sum("Line 6 of" in t for t in texts) == 1


def test_lines_planted_passages_go_whole(make):
    first, later = [], []
    for p in range(100):  # of 2 to 6 lines, between other neighbours
        passage = [f"Passage {p} line {i}: {p * 7919 % 1009} {i * 31 % 17}." for i in range(2 + p % 5)]
        first.append((p, "\n".join([*(f"Before {p} {k}." for k in range(3)), *passage, f"Behind {p}."]), "s"))
        later.append((1000 + p, "\n".join([f"Ahead {p}.", *passage, *(f"After {p} {k}." for k in range(4))]), "s"))
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(make(first + later)).collect()}
    assert all(got[i]["text"] == t and not got[i]["removed_lines"] for i, t, _ in first)
    whole = [p for p in range(100) if "Passage" not in got[1000 + p]["text"]]
    lost = [p for p in range(100) if got[1000 + p]["n_lines"] - got[1000 + p]["removed_lines"] < 5]
    assert (len(whole), len(lost)) == (100, 0)


def test_secrets_beside_harmless_parts_and_of_letters_only(make):
    secret = "q7Zt4Lw8Pb3Vn6Rc1Yd5mK2x"
    texts = {
        1: "KqZtLwPbVnRcYdHmJxGfTs", 2: f"0123456789{secret}", 3: f"{secret}/abcdefghijklmnop", 4: "x/KqZtLwPbVnRcYdHmJxGfTs12",
        5: "usr/share/documents/Public/userGuides/index12", 6: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 7: f"sha256-{secret}G9hJ0sAfEuBiT7oXq1z=",
    }
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["entropy"]] for r in secrets.find_secrets(make([(i, t, "s") for i, t in texts.items()])).collect()}
    assert got[1] == [texts[1]] and len(got[4]) == 1
    assert all(len(got[i]) == 1 and secret in got[i][0] for i in (2, 3))
    assert not got[5] and not got[6] and not got[7], got
