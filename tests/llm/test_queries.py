"""The registered queries over the smallest tables: contract columns, one row for each input row, and brute force where SQL can't express them."""

import hashlib
import os
import re

import pytest

from wherewise.llm import mixing
from wherewise.llm.queries import QUERIES, SQL, bpe_files

from .test_dedup import brute_near
from .test_spans import PII, SECRETS, brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")

CONTRACT = {
    "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op3": "doc_id keep_id group_size kept text_sha256", "op4": "doc_id n_shingles component_id kept", "op5": "doc_id held_out score predicted",
    "op6": "page_id payload_bytes payload_digest record_type refers_to", "op7": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op8": "doc_id size source_size target taken",
    "op9": "doc_id n_assign n_access n_hex base_sha256 spans", "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.fixture(scope="module")
def results(spark):
    return {k.split("_")[0]: f(spark, DATA).cache() for k, f in QUERIES.items()}


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_one_query_each():
    assert sorted(QUERIES, key=lambda k: int(k.split("_")[0][2:])) == list(QUERIES) and len(QUERIES) == 10
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("n", range(1, 11))
def test_rows_and_columns(spark, results, documents, n):
    got = results[f"op{n}"]
    assert set(CONTRACT.get(f"op{n}", "doc_id text").split()) <= set(got.columns)
    assert got.count() == (spark.read.parquet(f"{DATA}/pages.parquet").count() if n == 6 else len(documents))


@pytest.mark.parametrize("op, kinds", [("op2", PII), ("op9", SECRETS)])
def test_spans(results, documents, op, kinds):
    got = {r["doc_id"]: r for r in results[op].collect()}
    for i, text, _ in documents:
        found = sorted((s, [k for k, _, _ in kinds].index(k), e) for k, s, e in brute(text, kinds))
        base = ",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in found)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, got[i]["spans"].split(",")))


def test_components(results, documents):
    assert sorted(map(tuple, results["op4"].select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == brute_near(documents)


def test_mix(results, documents):
    size = {i: len(re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")) for i, t, _ in documents}
    totals, taken, target = {}, {}, {}
    for i, _, s in documents:
        totals[s] = totals.get(s, 0) + size[i]
    source = {i: s for i, _, s in documents}
    for r in results["op8"].collect():
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], totals[s]) and r["taken"] <= 2 * r["size"]
        taken[s], target[s] = taken.get(s, 0) + r["taken"], r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(totals.values()))
    assert all(abs(taken[s] - t) <= mixing.BLOCK for s, t in target.items())


def test_tokens(results, documents):
    tiktoken = pytest.importorskip("tiktoken")
    from wherewise.llm.bpe import read_ranks

    path, pattern = bpe_files()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in results["op10"].collect()}
    for i, text, _ in documents:
        ids = library.encode_ordinary(text or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
