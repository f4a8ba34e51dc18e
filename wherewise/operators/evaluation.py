"""Evaluation of answers: correctness, accuracy cubes, attribution of failures, probes and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions.geometry import r9

PAIR_OUTCOMES = ("no_answer", "frame_blind", "switched_correctly", "switched_incorrectly", "partial")


def correct(pred: Column, gold: Column, ambiguous: Column, flagged: Column) -> Column:
    none = F.size(gold) == 0
    return F.when(ambiguous & none, flagged).when(pred.isNull(), none).otherwise(F.array_contains(gold, pred))


def binary(groups: GroupedData, gold: Column, pred: Column) -> DataFrame:
    n = groups.agg(F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"), F.count_if(~gold & ~pred).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.when(tp > 0, 2.0 * tp / (2 * tp + fp + fn))
    return n.withColumns({"precision": r9(F.try_divide(tp.cast("double"), tp + fp)), "recall": r9(F.try_divide(tp.cast("double"), tp + fn)), "f1": r9(f1)})


def accuracy_cube(outcomes: DataFrame) -> DataFrame:
    axes = ["relation_type", "gold_frame", "difficulty", "scene_id"]
    return outcomes.groupingSets([[], *[[F.col(a)] for a in axes]], *axes).agg(F.count("*").alias("n"), r9(F.avg(F.col("correct").cast("int"))).alias("accuracy"), F.median("elapsed_ms").alias("median_ms"))


def by_item(outcomes: DataFrame) -> DataFrame:
    """One row per item and condition; an item counts as right if any of its rows is."""
    return outcomes.groupBy("item_key", "condition_key").agg(F.bool_or("correct").alias("correct"), F.bool_or("ambiguous_gold").alias("amb"), F.bool_and(F.col("pred").isNull()).alias("none"), F.min("relation_type").alias("relation_type"))


def attribution(items: DataFrame, baseline: str, gold_parse: str, oracle_frame: str) -> DataFrame:
    """Failures of the baseline with their cause: what the first condition that repairs them changed."""
    of = lambda k, name: items.where(F.col("condition_key") == k).select("item_key", F.col("correct").alias(name))
    rows = items.where((F.col("condition_key") == baseline) & ~F.col("correct")).join(of(gold_parse, "parse_ok"), "item_key", "left").join(of(oracle_frame, "frame_ok"), "item_key", "left")
    cause = F.when(F.col("amb"), "ambiguous_item").when(F.col("none"), "unresolvable").when(F.col("parse_ok"), "parse").when(F.col("frame_ok"), "frame_convention").otherwise("geometry")
    return rows.select("item_key", "relation_type", cause.alias("cause"))


def pair_outcome(given: list[str], gold: list[str]) -> Column:
    g, w = F.array(*given), F.array(*gold)
    right = F.size(F.filter(F.zip_with(g, w, lambda a, b: a == b), lambda c: c))
    return (
        F.when(F.size(F.array_compact(g)) < len(given), "no_answer")
        .when(F.size(F.array_distinct(g)) == 1, "frame_blind")
        .when(right == len(given), "switched_correctly")
        .when(right == 0, "switched_incorrectly")
        .otherwise("partial")
    )


def implied_frames(answer: Column, answers: Column) -> Column:
    n = F.size(F.filter(answers, lambda a: a == answer))
    return F.when(answer.isNull() | (n == 0), "no_frame").when(n == 1, "one_frame").otherwise("several_frames")


def reply_id(reply: Column) -> Column:
    """The id of the first JSON object in a reply, else the number that follows the word id."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.when(body != "", body))
    loose = F.regexp_extract(reply, r"(?i)\bid\D{0,5}(\d+)", 1)
    return F.when(parsed.isNotNull(), F.try_variant_get(parsed, "$.id", "long")).otherwise(F.when(loose != "", loose).cast("long"))


def answer_of(json: Column, key: str) -> Column:
    """A key's answer, under "answers" or not, plain or as the id of an object."""
    v = F.parse_json(json)
    return F.coalesce(*[F.try_variant_get(v, f"$.{p}{key}{s}", "long") for p in ("answers.", "") for s in (".id", "")])


def prompts(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """query_id, prompt, key: objects listed in an order keyed by query, so that position tells nothing."""
    lines = objects.groupBy("scene_id").agg(F.collect_list(F.struct("id", F.format_string("#%d %s at (%.2f, %.2f, %.2f)", "id", "label", "cx", "cy", "cz").alias("line"))).alias("lines"))
    rows = queries.select("query_id", "scene_id", "text").join(lines, "scene_id")
    order = F.array_sort(F.transform("lines", lambda s: F.struct(F.xxhash64(F.col("query_id"), s["id"]).alias("k"), s["line"].alias("line"))))
    prompt = F.concat_ws("\n", F.array_join(F.transform(order, lambda s: s["line"]), "\n"), F.lit("Which object is meant?"), "text")
    return rows.select("query_id", prompt.alias("prompt")).withColumn("key", F.substring(F.sha1(F.col("prompt").cast("binary")), 1, 12))


def trials(queries: DataFrame) -> DataFrame:
    block = F.explode(F.array(*[F.lit(b) for b in ("a", "b", "n", "c1", "c2")]))
    rows = queries.select("query_id", block.alias("block"))
    return rows.withColumn("trial", F.substring(F.sha1(F.concat(F.col("query_id").cast("string"), "block").cast("binary")), 1, 12))
