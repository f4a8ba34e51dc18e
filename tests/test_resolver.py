"""Phrases over rooms of hand-set boxes."""

import pytest
from pyspark.sql import functions as F

from wherewise.operators import parsing, resolver
from wherewise.operators import evaluation as E
from wherewise.sources import files

OBJECT = "scene_id long, id long, label string, adjective string, cx double, cy double, cz double, hx double, hy double, hz double, ux double, uy double, front_x double, front_y double, front_confidence double"


def thing(i, label, x, y, z=1.0, half=0.05, front=None):
    return (0, i, label, "", float(x), float(y), float(z), half, half, half, 1.0, 0.0, *(map(float, front) if front else (None, None)), 0.9 if front else 0.0)


@pytest.fixture(scope="module")
def room(spark):
    """Three mugs around a laptop that faces away from the viewer at (0, -5), and a table below one of them."""
    objects = [thing(1, "mug", -0.4, 0), thing(2, "mug", 0.4, 0), thing(3, "mug", 0, 0.5), thing(4, "laptop", 0, 0, front=(0, 1)), (0, 5, "table", "", 2.0, 0.0, 0.4, 0.5, 0.5, 0.4, 1.0, 0.0, None, None, 0.0), thing(6, "mug", 2.0, 0, 0.85)]
    rooms = spark.createDataFrame([(0, -3.0, 3.0, -6.0, 3.0, 0.0, 2.5, 0.3, 0.8)], "scene_id long, x0 double, x1 double, y0 double, y1 double, floor_z double, ceiling_z double, forward_margin double, axis_confidence double")
    return spark.createDataFrame(objects, OBJECT), rooms


def ask(spark, room, *texts, frame="egocentric"):
    q = spark.createDataFrame([(i, 0, t, 0.0, -5.0) for i, t in enumerate(texts)], "query_id long, scene_id long, text string, eye_x double, eye_y double")
    p = parsing.parsed(q.select("query_id", "text")).where("relation is not null").select("query_id", "relation", "relation_type", "target", "anchor")
    rows = resolver.resolve(q.join(p, "query_id"), *room, frame).collect()
    return {r["query_id"]: r for r in rows}


def test_left_right_behind(spark, room):
    r = ask(spark, room, "the mug to the left of the laptop", "the mug to the right of the laptop", "the mug behind the laptop", "the mug on the table")
    assert [r[i]["target_id"] for i in range(4)] == [1, 2, 3, 6]
    assert not any(r[i]["weak_match"] or r[i]["score_tie"] for i in range(4))


def test_frames_change_the_answer(spark, room):
    # the laptop faces away from the viewer: its own sides are the viewer's, and its front is behind it for the viewer
    r = ask(spark, room, "the mug to the left of the laptop", "the mug in front of the laptop", frame="intrinsic")
    assert [r[i]["target_id"] for i in range(2)] == [1, 3]
    assert ask(spark, room, "the mug to the left of the laptop", frame="addressee")[0]["target_id"] == 2


def test_nothing_there_is_a_weak_match(spark, room):
    assert ask(spark, room, "the mug in front of the laptop")[0]["weak_match"]


def test_a_scene_without_the_class_gives_no_row(spark, room):
    assert ask(spark, room, "the lamp to the left of the laptop") == {}


def test_every_phrase_has_a_row(spark, room):
    rows = [(0, "left", "mug", "laptop"), (1, "left", "mug", "helicopter"), (2, "on", "helicopter", "table"), (3, None, "mug", None), (4, None, "laptop", None), (5, "left", "laptop", "helicopter"), (6, None, None, None)]
    q = spark.createDataFrame([(i, 0, r, "projective_lateral", t, a, 0.0, -5.0) for i, r, t, a in rows], "query_id long, scene_id long, relation string, relation_type string, target string, anchor string, eye_x double, eye_y double")
    got = {r["query_id"]: r for r in resolver.every(q, *room).collect()}
    assert [got[i]["target_id"] for i in range(7)] == [1, 1, None, 1, 4, 4, None]
    assert [got[i]["no_candidate"] for i in range(7)] == [False, True, True, False, False, True, True]
    assert [got[i]["weak_match"] for i in range(7)] == [False, True, False, False, False, True, False]
    assert [got[i]["score_tie"] for i in range(7)] == [False, True, False, True, False, False, False]
    assert (got[3]["score"], got[3]["second"], got[4]["second"], got[2]["score"]) == (1.0, 1.0, None, None)
    assert resolver.every(q.where("false"), *room).collect() == []


def test_outcomes_of_pairs(spark):
    rows = [((None, 1), (1, 2), "no_answer"), ((1, 1), (1, 2), "frame_blind"), ((1, 2), (1, 2), "switched_correctly"), ((2, 1), (1, 2), "switched_incorrectly"), ((1, 3), (1, 2), "partial")]
    df = spark.createDataFrame([(*g, *w, o) for g, w, o in rows], "ga int, gb int, wa int, wb int, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", E.pair_outcome(["ga", "gb"], ["wa", "wb"])).collect())


@pytest.mark.parametrize("reply, answer", [('{"id": 4}', 4), ('```json\n{"id": 12, "why": "x"}\n```', 12), ("I say id = 7.", 7), ("none", None), ('{"id": null}', None), ("", None)])
def test_replies(spark, reply, answer):
    assert spark.range(1).select(E.reply_id(F.lit(reply)).alias("a")).first()["a"] == answer


def test_correctness(spark):
    df = spark.createDataFrame([(1, [1], False, False, True), (2, [1], False, True, False), (None, [1], False, False, False), (None, [], False, False, True), (3, [], True, False, False), (3, [], True, True, True), (2, [1, 2], True, False, True)], "p int, g array<int>, a boolean, f boolean, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", E.correct(F.col("p"), F.col("g"), F.col("a"), F.col("f"))).collect())


def test_items_with_a_repeated_id_are_an_error(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text('// comment\n\n{"id": "x", "text": "t"}\n')
    assert files.read_items(spark, str(tmp_path / "a")).count() == 1
    with pytest.raises(Exception, match="occurs twice"):
        files.read_items(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    (tmp_path / "a").write_text("{broken\n")
    with pytest.raises(Exception):
        files.read_items(spark, str(tmp_path / "a")).collect()


def test_scenes_of_another_version_are_refused(spark, tmp_path, room):
    files.write_scenes({"objects": room[0]}, str(tmp_path / "s"))
    assert files.read_scenes(spark, str(tmp_path / "s"), "objects").count() == 6
    room[0].withColumn("schema_version", F.lit(2)).write.parquet(str(tmp_path / "t" / "objects"))
    with pytest.raises(Exception, match="schema version"):
        files.read_scenes(spark, str(tmp_path / "t"), "objects").collect()


def test_ply_round_trip():
    import numpy as np

    p, c = np.arange(12.0).reshape(4, 3), np.array([[0, 0.5, 1.0]] * 4)
    q, d, f = files.parse_ply(files.format_ply(p, c))
    assert (p == q).all() and (d == [0, 127, 255]).all() and len(f) == 0
    text = b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n4 0 1 2 0\n"
    q, d, f = files.parse_ply(text)
    assert len(q) == 3 and d is None and f.tolist() == [[0, 1, 2]]


def test_config(tmp_path):
    from wherewise.plans.config import Config

    (tmp_path / "c.yaml").write_text("projective:\n  cone_half_angle_deg: 60  # wider\nvertical:\n  contact_tol: 0.1\n")
    c = Config.load(str(tmp_path / "c.yaml"))
    assert (c.cone_half_angle_deg, c.contact_tol, c.near_base) == (60.0, 0.1, 0.30)
    (tmp_path / "c.yaml").write_text("no_such: 1\n")
    with pytest.raises(KeyError):
        Config.load(str(tmp_path / "c.yaml"))
    assert Config.load(str(tmp_path / "missing.yaml")) == Config()


def test_sweep_answers_as_every_pair_under_every_trial_does(spark):
    from dataclasses import replace

    from wherewise.functions.geometry import prefixed
    from wherewise.operators import frames
    from wherewise.operators import relations as R
    from wherewise.plans.config import CFG, MAX_ANCHORS, MIN_ANSWER
    from wherewise.plans.fixtures import Tables

    x = Tables(spark, "/root/testdata/sf0.001")
    q = x.utterances.where("relation_type like 'projective%' and query_id < 700").withColumn("eye_x", F.when(F.col("query_id") % 9 == 0, F.col("query_id") / 100.0).otherwise(3.0)).cache()
    trials = [(0, 25.0, 55.0, 0.45), (1, 19.5, 71.0, 0.35), (2, 40.0, 43.0, 0.58)]
    got = resolver.trial_answers(q, x.objects, x.rooms, trials).cache()
    asks = {}
    for r in q.collect():
        asks.setdefault((r.scene_id, r.relation, r.target, r.anchor, r.eye_x, r.eye_y), []).append(r.query_id)
    first = {min(ids): len(ids) for ids in asks.values()}
    assert len(first) < q.count() and all(first[r.question] == r.asked for r in got.collect())  # one row for what is asked again and again

    a = prefixed(x.objects, "a", ("scene_id",)).withColumnRenamed("a_label", "anchor").selectExpr("*", "row_number() over (partition by scene_id, anchor order by a_hx * a_hy * a_hz desc, a_id) as a_rank").where(f"a_rank <= {MAX_ANCHORS}")
    rows = frames.with_axes(q.drop("text").join(a, ["scene_id", "anchor"]).join(x.rooms, "scene_id"), F.col("eye_x"), F.col("eye_y")).where("kind in ('egocentric', 'intrinsic') and available")
    pairs = R.facing(R.with_frame_spans(rows.join(prefixed(x.objects, "t", ("scene_id",)).withColumnRenamed("t_label", "target"), ["scene_id", "target"]).where("t_id <> a_id")))
    want = {}
    for trial, full, half, slack in trials:
        value = R.projective(replace(CFG, cone_full_credit_deg=full, cone_half_angle_deg=half, depth_overlap_slack=slack))
        for r in pairs.select("query_id", "kind", "t_id", value.alias("v")).collect():
            k = (r.query_id, r.kind, trial)
            want[k] = max(want.get(k, (0.0, 0)), (r.v, -r.t_id))
    want = {k: -o for k, (v, o) in want.items() if v >= MIN_ANSWER}
    assert {k: v for k, v in want.items() if k[0] in first} == {(r.question, r.kind, r.trial): r.answer for r in got.collect() if r.answer is not None}

    split = {(i, t) for i, k, t in want for o in ("egocentric", "intrinsic") if want.get((i, o, t), want[i, k, t]) != want[i, k, t]}
    n = q.count()
    table = resolver._trials(20, 0.3, 0)
    assert table[0] == trials[0]
    assert resolver.sweep(q, x.objects, x.rooms).first()["baseline"] == sum(t == 0 for _, t in split) / n


@pytest.mark.parametrize("name", ["rob_sweep", "rob_report"])
def test_generated_code_of_the_sweep_compiles(spark, name):
    from wherewise.plans.all_queries import QUERIES

    strict = {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    for k, v in strict.items():
        spark.conf.set(k, v)
    try:  # without a fallback, code beyond 64 KB is an error
        rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    finally:
        for k in strict:
            spark.conf.unset(k)
    assert [r["line_no"] for r in rows] == [-1, 0, 1] if name == "rob_report" else 0 < rows[0]["least"] <= rows[0]["median"] <= rows[0]["most"] < 1


def test_questions_that_all_trials_answer_alike_are_not_crossed_with_trials(spark):
    from wherewise.plans.fixtures import Tables

    x = Tables(spark, "/root/testdata/sf0.001")
    q = x.utterances.where("relation_type like 'projective%'")
    trials = resolver._trials(20, 0.3, 0)
    rows = resolver._answers(q, x.objects, x.rooms, trials).cache()
    settled = {(r.question, r.kind): r.answer for r in rows.where("trial is null").collect()}
    assert settled and None not in settled.values()
    assert not {r.question for r in rows.where("trial is not null").collect()} & {i for i, _ in settled}
    # the two settings at the ends, asked alone so that their bounds are their values, agree with what holds in all trials
    ends = [(0, *(f(t[i] for t in trials) for i in (1, 2, 3))) for f in (min, max)]
    for end in ends:
        alone = {(r.question, r.kind): r.answer for r in resolver.trial_answers(q, x.objects, x.rooms, [end]).collect()}
        assert settled == {k: alone.get(k) for k in settled}
    spread = resolver.trial_answers(q, x.objects, x.rooms, trials).where("trial is not null")
    n = spread.groupBy("question", "kind").count().collect()
    assert {k: 21 for k in settled} == {(r.question, r.kind): r["count"] for r in n if (r.question, r.kind) in settled}


def test_report_needs_no_tables_of_python_rows(spark):
    from wherewise.plans.all_queries import QUERIES

    plan = QUERIES["rob_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan


def test_few_questions_become_many_pairs_in_all_tasks(spark):
    from wherewise.plans.fixtures import Tables

    x = Tables(spark, "/root/testdata/sf0.001")
    rows = resolver._answers(x.utterances.where("relation_type like 'projective%'"), x.objects, x.rooms, resolver._trials(20, 0.3, 0))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("REPARTITION_BY_NUM")  # plans are printed from the result down; that shuffle is not coalesced
    assert "t_label" in plan[:dealt] or "t_id" in plan[:dealt]
    assert "REPARTITION_BY_COL" not in plan


def test_sweep_jitters_every_threshold_and_constant():
    from dataclasses import astuple

    from wherewise.plans.config import CFG, Constants, settings

    rows = settings()
    assert [r[0] for r in rows] == list(range(21)) and rows[0] == (0, CFG, Constants())
    flat = [astuple(c) + astuple(k) for _, c, k in rows]
    assert len(flat[0]) == 43 and all(len(set(v)) > 10 for v in zip(*flat))
    for _, c, _ in [*rows, *settings(200, 1.5, 1)]:
        assert c.cone_full_credit_deg < c.cone_half_angle_deg and c.lateral_separation_zero < c.lateral_separation_full <= 1 and c.height_band < c.height_band_hard
        assert c.proximity_full_factor < c.proximity_zero_factor < c.proximity_cutoff_factor and c.between_span_lo < c.between_span_hi and c.above_gap_zero >= 0.1


def test_sweep_answers_as_every_pair_under_all_thresholds_does(spark):
    from collections import Counter

    from wherewise.functions.geometry import prefixed
    from wherewise.operators import frames
    from wherewise.operators import relations as R
    from wherewise.plans.config import MAX_ANCHORS, settings
    from wherewise.plans.fixtures import Tables

    x = Tables(spark, "/root/testdata/sf0.001")
    q = x.utterances.where("relation_type like 'projective%' and query_id < 700").cache()
    trials = settings(3, 0.4, 5)
    a = prefixed(x.objects, "a", ("scene_id",)).withColumnRenamed("a_label", "anchor").selectExpr("*", "row_number() over (partition by scene_id, anchor order by a_hx * a_hy * a_hz desc, a_id) as a_rank").where(f"a_rank <= {MAX_ANCHORS}")
    rows = frames.with_axes(q.drop("text").join(a, ["scene_id", "anchor"]).join(x.rooms, "scene_id"), F.col("eye_x"), F.col("eye_y")).where("kind in ('egocentric', 'intrinsic') and available")
    pairs = R.facing(R.with_frame_spans(rows.join(prefixed(x.objects, "t", ("scene_id",)).withColumnRenamed("t_label", "target"), ["scene_id", "target"]).where("t_id <> a_id"))).localCheckpoint()
    want = {}
    for trial, cfg, constants in trials:
        value = F.when(R.encloses(cfg).isNull(), R.projective(cfg)).otherwise(0.0)
        for r in pairs.select("query_id", "kind", "t_id", value.alias("v")).groupBy("query_id", "kind").agg(F.max(F.struct("v", (-F.col("t_id")).alias("o"))).alias("top")).collect():
            if r.top.v >= constants.min_answer:
                want[r.query_id, r.kind, trial] = -r.top.o
    got = {(r.question, r.kind, r.trial): r.answer for r in resolver.trial_answers(q, x.objects, x.rooms, trials, enclosing=True).collect() if r.answer is not None}
    asked = {i for i, _, _ in got}
    assert len(asked) > 50 and got == {k: v for k, v in want.items() if k[0] in asked}

    one = resolver.sweep(q, x.objects, x.rooms, 3, 0.4, 5).first()
    kind = {r.query_id: r.relation_type for r in q.collect()}
    n, split = Counter(kind.values()), Counter((kind[i], t) for i, k, t in want if k == "egocentric" and want.get((i, "intrinsic", t), want[i, k, t]) != want[i, k, t])
    assert [r.relation_type for r in one.by_type] == sorted(n)
    for r in one.by_type:
        rates = sorted(split[r.relation_type, t] / n[r.relation_type] for t in (1, 2, 3))
        assert (r.baseline, r.least, r.median, r.most) == pytest.approx((split[r.relation_type, 0] / n[r.relation_type], *rates))
    rates = sorted(sum(split[k, t] for k in n) / len(kind) for t in (1, 2, 3))
    assert (one.least, one.median, one.most) == pytest.approx(tuple(rates)) and rates[0] < rates[2]


def test_sweep_counts_trials_without_an_answer(spark, room):
    q = spark.createDataFrame([(1, 0, "left", "projective_lateral", "unicorn", "cup", 3.0, -1.0)], "query_id long, scene_id long, relation string, relation_type string, target string, anchor string, eye_x double, eye_y double")
    one = resolver.sweep(q, *room[:2], trials=2).first()
    assert (one.baseline, one.least, one.most, one.by_type[0].relation_type, one.by_type[0].most) == (0.0, 0.0, 0.0, "projective_lateral", 0.0)
    none = resolver.sweep(q.where("false"), *room[:2], trials=2).first()
    assert (none.baseline, none.median, none.by_type) == (None, None, [])
