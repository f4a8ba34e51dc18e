"""Matches, classification and streams against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from wherewise.operators import masks
from wherewise.streaming import events as S

NOON = datetime(2024, 1, 16, 12)


def greedy(pairs):
    g, p, out = set(), set(), []
    for iou, a, b in sorted(((i, a, b) for a, b, i in pairs), key=lambda r: (-r[0], r[1], r[2])):
        if a not in g and b not in p:
            g.add(a)
            p.add(b)
            out.append((a, b, iou))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_matches_are_those_of_a_greedy_pass(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b, rng.choice([0.25, 0.5, 0.75])) for a in range(12) for b in range(15) if rng.random() < 0.4]
    got = masks.match(spark.createDataFrame(pairs, "gt_id long, pred_id long, iou double")).collect()
    assert sorted(map(tuple, got)) == greedy(pairs)


def test_a_long_chain_of_falling_overlaps_is_matched(spark):
    pairs = [(i // 2, (i + 1) // 2, 1.0 - i / 10) for i in range(8)]
    got = masks.match(spark.createDataFrame(pairs, "gt_id long, pred_id long, iou double")).collect()
    assert sorted(map(tuple, got)) == greedy(pairs)


def test_no_pairs_no_matches(spark):
    assert masks.match(spark.createDataFrame([], "gt_id long, pred_id long, iou double")).collect() == []


def test_classes_of_blocks_of_labels_are_those_of_all_at_once(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)) / 5
    v[30] = v[3]  # a tie between the texts of two labels goes to the smaller label
    label = np.arange(60) % 30
    label[30] = 29
    rows = [(i, int(label[i]), [float(x) for x in v[i].astype(np.float32)]) for i in range(60)] + [(99, None, None), (98, 1, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    first = {int(k): min(i for i in range(60) if label[i] == k) for k in set(label)}
    v = v.astype(np.float32).astype(float)
    want = {}
    for i in range(60):
        x = np.array([100 * v[i] @ v[first[k]] for k in sorted(first)])
        e = np.exp(x - x.max())
        want[i] = (sorted(first)[int((np.round(e, 12) == 1).argmax())], 1 / e.sum())
    for block in (2048, 7):
        got = {r["vec_id"]: (r["label"], r["prob"]) for r in masks.classify(df, labels=block).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
    assert masks.classify(df.where("false")).collect() == []


def events_of(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")


def hours(events):
    from pyspark.sql import functions as F

    return S.timed(events).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(S.start_of("window"), "n")


def test_rows_behind_the_watermark_are_dropped_and_others_counted(spark):
    first = events_of(spark, [(1, NOON, 1, "a"), (2, NOON + timedelta(hours=3, minutes=5), 1, "a")])  # watermark: 14:55
    late = [(3, NOON + timedelta(minutes=1), 1, "a"), (4, NOON + timedelta(hours=1, minutes=59), 1, "a")]
    fine = [(5, NOON + timedelta(hours=2), 1, "a"), (6, NOON + timedelta(hours=3, minutes=30), 1, "a"), (7, None, 1, "a")]
    updates = S.arrivals([first, events_of(spark, late + fine)], hours)
    got = {}
    for r in updates.collect():
        got[r["start"]] = max(got.get(r["start"], 0), r["n"])
    assert got == {NOON: 1, NOON + timedelta(hours=2): 1, NOON + timedelta(hours=3): 2}


def test_sessions_as_a_stream(spark, tmp_path):
    rows = [(i, NOON + timedelta(minutes=m), u, "a") for i, (u, m) in enumerate([(1, 0), (1, 29), (1, 59), (2, 10), (1, 58)])]
    events_of(spark, rows).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, S.run(S.sessions(S.stream(spark, str(tmp_path)))).select("user_id", "start", "n").collect()))
    assert got == [(1, NOON, 4), (2, NOON + timedelta(minutes=10), 1)]


def test_a_stream_of_nothing(spark, tmp_path):
    events_of(spark, []).write.parquet(f"{tmp_path}/events.parquet")
    assert S.run(S.latest(S.stream(spark, str(tmp_path)))).collect() == []
