import gzip
import hashlib
import os

import pytest

from wherewise.llm import warc
from wherewise.llm.common import fresh_path

BIG = "<p>" + "payload é " * 200 + "</p>"
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2 x\r\ny", BIG), (7, None, BIG), (3, "http://b/é", "<p>small</p>"), (4, "http://b", "<p>small</p>"), (5, "u", None), (6, "u", ""), (None, "u", BIG), (8, "u", "x" * 300_000), (9, "u", BIG + "!"), (9, "u", BIG + "!")]


def expected(rows):
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = best.get(h) if len(b) >= 1000 and best.get(h) != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS shard", "'own' AS cell", "'own' AS n")


@pytest.mark.parametrize("shard, few", [(1 << 20, 1000), (2000, 0)])
def test_round_trip(spark, shard, few):
    uri = fresh_path(spark, "warc-test")
    files = warc.write_warc(pages(spark, ROWS), uri, shard_bytes=shard, roll=1500, broadcast_groups=few)
    assert files.agg({"records": "sum"}).first()[0] == len(ROWS)
    got = warc.read_warc(spark, uri).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(ROWS)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    folder = uri.removeprefix("file://")
    assert not os.path.exists(f"{folder}/_tmp")
    for f in files.collect():
        data = open(f"{folder}/{f['name']}", "rb").read()
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_same_bytes_again(spark):
    sums = []
    for parts in (1, 5):
        uri = fresh_path(spark, "warc-test")
        sums.append(sorted(map(tuple, warc.write_warc(pages(spark, ROWS).repartition(parts), uri, shard_bytes=5000, roll=1500).collect())))
    assert sums[0] == sums[1] and len(sums[0]) > 2


def test_files_outside_the_list_are_not_read(spark):
    uri = fresh_path(spark, "warc-test")
    warc.write_warc(pages(spark, ROWS[:2]), uri)
    open(uri.removeprefix("file://") + "/part-999999-0000.warc.gz", "wb").write(b"not a record")
    assert warc.read_warc(spark, uri).count() == 2


def test_ids_over_the_whole_range_and_of_no_page(spark):
    rows = [(9 * 10**18, "u", BIG), (-9 * 10**18, "u", BIG), (0, "v", "small"), *((None, f"u{i}", f"{i} " * 400) for i in range(40))]
    uri = fresh_path(spark, "warc-test")
    files = warc.write_warc(pages(spark, rows), uri, shard_bytes=8000)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, uri).collect()), key=str) == expected(rows)
    assert files.select("shard").distinct().count() > 3 and max(f["records"] for f in files.collect()) < 20


def test_writing_again_leaves_one_list(spark):
    uri = fresh_path(spark, "warc-test")
    with pytest.raises(FileNotFoundError):
        warc.read_warc(spark, uri)
    for rows in (ROWS, ROWS[:3]):
        warc.write_warc(pages(spark, rows), uri)
        assert warc.read_warc(spark, uri).count() == len(rows)
    assert sorted(x for x in os.listdir(uri.removeprefix("file://")) if x.startswith("_")) == ["_manifest-00000001"]


def test_revisits_say_where_to(spark):
    text = warc.record(1, "http://a b", b"payload", 2, "http://c d").decode()
    assert "WARC-Refers-To-Target-URI: http://c%20d\r\n" in text and "WARC-Refers-To-Date: " in text and warc.parse(warc.info("x")) is None


def test_damage_is_found():
    good = warc.record(1, "http://x", b"payload", None)
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"pAyload\r\n"))


def test_empty_table(spark):
    uri = fresh_path(spark, "warc-test")
    warc.write_warc(pages(spark, []), uri)
    assert warc.read_warc(spark, uri).count() == 0


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as P
    from wherewise.llm import minhash_dedup, toxicity
    from wherewise.llm.common import table

    docs = table(spark, DATA, "documents")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "byte-level BPE"]
    seen = {}
    for name, stage in P.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, DATA).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = (before, docs)
        assert name == "byte-level BPE" or docs.columns == columns
    first, clean = seen["toxicity"]
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(first, toxicity.fit(first, table(spark, DATA, "labels"))).collect()}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, p in scores.items() if not p)
    before, after = seen["exact dedup"]
    norm = lambda df: ["".join((r["text"] or "").split(" ")).translate({c: None for c in range(9, 14)}) for r in df.collect()]
    assert sorted(norm(after)) == sorted(set(norm(before)))
    before, after = seen["near dedup"]
    kept = {r["component_id"] for r in minhash_dedup.minhash_components(before, percent=P.NEAR_PERCENT, floor=P.NEAR_FLOOR).collect()}
    assert {r["doc_id"] for r in after.collect()} == kept
    before, after = seen["mixing"]
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in before.collect()}
    taken = {}
    for r in after.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(n <= 2 * words[i] for i, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(words.values())) < 0.02 * sum(words.values())
    before, after = seen["byte-level BPE"]
    assert after.count() == before.count() and sorted(r["decoded_sha256"] for r in after.collect()) == sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in before.collect())
