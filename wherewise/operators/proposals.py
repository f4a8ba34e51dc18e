"""Benchmark items and proposals: usable objects, salient anchors, class pairs under frames, and generated phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import prefixed
from ..plans.config import MIN_ANSWER
from . import frames
from . import relations as R

#: Columns that an annotator may see.
BLIND = ("query_id", "scene_id", "text")
# fixed values: how well classes serve as anchors; others weigh 1
SALIENT = {
    "whiteboard": 3.0, "door": 3.0, "window": 2.6, "tv": 2.6, "monitor": 2.2, "table": 2.4, "desk": 2.6, "sofa": 2.6, "bed": 2.6, "bookshelf": 2.4, "shelf": 2.2, "cabinet": 2.0, "storage cabinet": 2.0, "wardrobe": 2.2,
    "office chair": 2.0, "chair": 2.0, "sink": 2.2, "toilet": 2.2, "refrigerator": 2.4, "stairs": 2.2, "pillar": 1.8, "dresser": 2.0, "nightstand": 1.8, "coffee table": 2.0, "dining table": 2.4, "counter": 2.2, "kitchen counter": 2.2,
    "printer": 1.6, "heater": 1.4, "keyboard": 1.4, "laptop": 1.8, "computer tower": 1.4, "trash can": 1.4, "plant": 1.6, "lamp": 1.4, "picture": 1.6, "mirror": 1.8, "curtain": 1.2,
}
POOR = "power socket, wall outlet, light switch, thermostat, electrical duct, electric duct, blind rail, door frame, window frame, fake ceiling, ceiling, vent, pipe, rug, ceiling lamp, whiteboard eraser, object, wall".split(", ")
TEMPLATES = {"left": "the {t} to the left of the {a}", "right": "the {t} to the right of the {a}", "front": "the {t} in front of the {a}", "behind": "the {t} behind the {a}"}


def usable(objects: DataFrame, least: float = 0.05) -> DataFrame:
    d = 2.0 * F.sqrt(F.col("hx") * F.col("hx") + F.col("hy") * F.col("hy") + F.col("hz") * F.col("hz"))
    return objects.withColumns({"diameter": d, "volume": F.col("hx") * F.col("hy") * F.col("hz") * 8.0}).where(F.col("diameter") >= least)


def salience(objects: DataFrame) -> DataFrame:
    base = F.lit(1.0)
    for k, v in SALIENT.items():
        base = F.when(F.col("label") == k, v).otherwise(base)
    g = usable(objects).where(~F.col("label").isin(*POOR)).groupBy("scene_id", "label").agg(F.median("volume").alias("v"), F.count("*").alias("n"), F.bool_or(F.col("front_x").isNotNull()).alias("oriented"))
    size = F.least(F.lit(1.0), F.log1p(F.col("v") * 20.0) / 3.0)
    value = base * (0.45 + 0.35 * size + 0.20 / (1.0 + 0.25 * (F.col("n") - 1))) + F.when(F.col("oriented"), 0.3).otherwise(0.0)
    return g.select("scene_id", "label", "n", value.alias("salience"))


def class_pairs(objects: DataFrame, rooms: DataFrame, direction: str, eye: tuple[float, float] = (3.0, -1.0)) -> DataFrame:
    """scene_id, target, anchor, kind, best, answer: the best object pair of each two classes under each frame."""
    a = prefixed(objects, "a", ("scene_id",)).join(rooms.select("scene_id", "forward_margin", "axis_confidence"), "scene_id")
    kinds = ("egocentric", "intrinsic", "addressee", "world")
    f = frames.with_axes(a, F.lit(eye[0]), F.lit(eye[1])).where(F.col("kind").isin(*kinds) & F.col("available"))
    rows = f.join(prefixed(objects, "t", ("scene_id",)), "scene_id").where("t_label <> a_label")
    scored = R.facing(R.with_frame_spans(rows), direction).select("scene_id", F.col("t_label").alias("target"), F.col("a_label").alias("anchor"), "kind", "t_id", R.projective().alias("v"))
    best = scored.groupBy("scene_id", "target", "anchor", "kind").agg(F.max(F.struct(F.round("v", 9).alias("v"), (-F.col("t_id")).alias("o"))).alias("b"), F.max("v").alias("best"))
    return best.select("scene_id", "target", "anchor", "kind", "best", F.when(F.col("best") >= MIN_ANSWER, -F.col("b.o")).alias("answer"))


def propose_directions(objects: DataFrame, rooms: DataFrame, most: int = 25) -> DataFrame:
    near = prefixed(objects, "t", ("scene_id",)).join(prefixed(objects, "a", ("scene_id",)), "scene_id").where("t_label <> a_label")
    d2 = (F.col("t_cx") - F.col("a_cx")) ** 2 + (F.col("t_cy") - F.col("a_cy")) ** 2 + (F.col("t_cz") - F.col("a_cz")) ** 2
    close = near.where(d2 < 3.5**2).select("scene_id", F.col("t_label").alias("target"), F.col("a_label").alias("anchor")).distinct()
    out = None
    for relation, template in TEMPLATES.items():
        g = class_pairs(objects, rooms, relation).groupBy("scene_id", "target", "anchor").agg(F.count("answer").alias("frames"), (F.count_distinct("answer") > 1).alias("sensitive")).where("frames > 0")
        g = g.join(close, ["scene_id", "target", "anchor"], "left_semi").withColumn("relation", F.lit(relation))
        w = Window.partitionBy("scene_id").orderBy(F.col("sensitive").desc(), F.col("frames").desc(), "anchor", "target")
        before, mid, after = template.replace("{t}", "|").replace("{a}", "|").split("|")
        text = F.concat(F.lit(before), "target", F.lit(mid), "anchor", F.lit(after))
        g = g.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("scene_id", "relation", text.alias("text"), "sensitive", "frames")
        out = g if out is None else out.unionByName(g)
    return out


def propose_ordinals(objects: DataFrame) -> DataFrame:
    word = F.explode(F.array(F.lit("first"), F.lit("second"), F.lit("third"))).alias("word")
    many = objects.groupBy("scene_id", "label").agg(F.count("*").alias("n")).where("n >= 3").select("scene_id", "label", "n", word)
    many = many.select("*", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    return many.select("scene_id", F.concat(F.lit("the "), "word", F.lit(" "), "label", F.lit(" from the "), "side").alias("text"), "n")


def propose_superlatives(objects: DataFrame) -> DataFrame:
    size = {"tallest": F.col("hz"), "biggest": F.col("hx") * F.col("hy") * F.col("hz"), "smallest": -(F.col("hx") * F.col("hy") * F.col("hz"))}
    aggs = [F.max_by("id", v * 1000000 - F.col("id") / 1000000.0).alias(w) for w, v in size.items()]
    g = objects.groupBy("scene_id", "label").agg(F.count("*").alias("n"), *aggs).where("n >= 2")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(w).alias("answer")) for w in size])).alias("w")
    return g.select("scene_id", "label", each).select("scene_id", F.concat(F.lit("the "), "w.word", F.lit(" "), "label").alias("text"), "w.answer")


def sample_items(utterances: DataFrame) -> DataFrame:
    """Items from phrases, with defects planted by number."""
    q = F.col("query_id")
    return utterances.select(
        "query_id", "scene_id", "relation_type", F.when(q % 11 == 0, "").otherwise(F.concat(F.lit("q"), q)).alias("id"), F.when(q % 13 == 0, " ").otherwise(F.col("text")).alias("text"),
        F.when(q % 7 == 0, "bogus").otherwise("egocentric").alias("frame"), (q % 5 == 0).alias("ambiguous"), F.when(q % 10 == 0, "none").otherwise("anchor").alias("ambiguity_kind"), (q % 3).alias("n_targets"),
        F.when(q % 17 == 0, "extreme").when(q % 2 == 0, "easy").otherwise("hard").alias("difficulty"), F.when(q % 4 == 0, "position").otherwise("best_view").alias("viewpoint_mode"), F.lit(None).cast("array<double>").alias("viewpoint_position"),
    )


def problems() -> Column:
    """What is wrong with an item, as an array of messages."""
    rules = [
        (F.col("id") == "", "missing id"),
        (F.trim("text") == "", "empty text"),
        (~F.col("frame").isin("egocentric", "intrinsic", "addressee", "world", "any"), "unknown frame"),
        (F.col("ambiguous") & (F.col("ambiguity_kind") == "none"), "ambiguous without a kind"),
        (~F.col("ambiguous") & (F.col("n_targets") != 1), "needs exactly one target"),
        (~F.col("difficulty").isin("easy", "medium", "hard"), "unknown difficulty"),
        ((F.col("viewpoint_mode") == "position") & F.col("viewpoint_position").isNull(), "needs a viewpoint position"),
    ]
    return F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))


def mentioned(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """query_id, id, label: objects whose class is a word of the text."""
    words = queries.select("query_id", "scene_id", F.explode(F.array_distinct(F.split("text", " "))).alias("label"))
    return words.join(objects.select("scene_id", "id", "label"), ["scene_id", "label"]).select("query_id", "id", "label")
