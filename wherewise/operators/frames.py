"""Reference frames: axes read at an anchor, one row per anchor and kind, and the policy that chooses one.

right and front are unit vectors of the plane. An egocentric front points towards the viewer, so that frame is left-handed on
purpose; an addressee frame is the intrinsic one with right and left exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clip, horizontal
from ..plans.config import EYE_HEIGHT, MIN_FRONT_CONFIDENCE, MIN_USABLE_CONFIDENCE

KINDS = ("egocentric", "egocentric_bearing", "egocentric_image", "intrinsic", "addressee", "world")
# fixed values: priors by group of relation
PRIORS = {
    "front_back": {"intrinsic": 1.00, "egocentric": 0.55, "addressee": 0.25, "world": 0.15},
    "left_right": {"egocentric": 1.00, "intrinsic": 0.55, "addressee": 0.35, "world": 0.15},
}
GROUPS = {"front": "front_back", "behind": "front_back", "left": "left_right", "right": "left_right", "ordinal": "left_right"}


def with_egocentric(pairs: DataFrame, eye_x: Column, eye_y: Column) -> DataFrame:
    """Adds the axes rx, ry, fx, fy of a viewer who looks at the anchor (a_*)."""
    lx, ly = horizontal(F.col("a_cx") - eye_x, F.col("a_cy") - eye_y)
    return pairs.withColumns({"lx": lx, "ly": ly}).withColumns({"rx": F.col("ly"), "ry": -F.col("lx"), "fx": -F.col("lx"), "fy": -F.col("ly")})


def room_scale() -> Column:
    w, d, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("ceiling_z") - F.col("floor_z")
    return F.greatest(F.lit(1.0), F.sqrt(w * w + d * d + h * h))


def with_axes(rows: DataFrame, eye_x: Column, eye_y: Column) -> DataFrame:
    """Explodes rows with an anchor (a_*) and its room (forward_margin, axis_confidence; forward is +y) into one per kind of frame, adding
    kind, rx, ry, fx, fy, confidence, available, reason."""
    lx, ly = horizontal(F.col("a_cx") - eye_x, F.col("a_cy") - eye_y)
    gx, gy = horizontal(F.col("a_front_x"), F.col("a_front_y"))
    rows = rows.withColumns({"lx": lx, "ly": ly, "gx": gx, "gy": gy})
    lx, ly, gx, gy = (F.col(c) for c in ("lx", "ly", "gx", "gy"))
    rows = rows.withColumns({"looks": (lx != 0) | (ly != 0), "faces": F.col("a_front_x").isNotNull() & ((gx != 0) | (gy != 0)), "sure": clip(F.least(F.col("forward_margin") / 0.30, F.col("axis_confidence")))})
    zero, one = F.lit(0.0), F.lit(1.0)
    front = F.coalesce(F.col("a_front_confidence"), zero)
    above, faceless = "the viewer is straight above or below the anchor", "the anchor has no front"
    kinds = {
        "egocentric": (ly, -lx, -lx, -ly, one, F.col("looks"), above),
        "egocentric_bearing": (ly, -lx, -lx, -ly, one, F.col("looks"), above),
        "egocentric_image": (zero, zero, zero, zero, zero, F.lit(False), "a bare position has no camera pose"),
        "intrinsic": (gy, -gx, gx, gy, front, F.col("faces"), faceless),
        "addressee": (-gy, gx, gx, gy, front, F.col("faces"), faceless),
        "world": (one, zero, zero, one, F.col("sure"), F.lit(True), ""),
    }
    names = ("rx", "ry", "fx", "fy", "confidence", "available", "reason")
    every = F.array(*[F.struct(F.lit(k).alias("kind"), *[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, vs, strict=True)]) for k, vs in kinds.items()])
    rows = rows.withColumn("frame", F.explode(every)).drop("lx", "ly", "gx", "gy", "looks", "faces", "sure")
    there = F.col("frame.available")
    only = {c: F.when(there, F.col(f"frame.{c}")) for c in ("rx", "ry", "fx", "fy")}
    return rows.withColumns({"kind": F.col("frame.kind"), **only, "confidence": F.when(there, F.col("frame.confidence")).otherwise(0.0), "available": there, "reason": F.when(~there, F.col("frame.reason"))}).drop("frame")


def prior_of(kind: Column, group: Column, front_confidence: Column, room_shell: Column, cue_weight: Column) -> Column:
    """A kind's prior: by group, raised for the room's shell, lowered for a vague front, and dominated by what the sentence says."""
    base = F.lit(0.0)
    for g, table in PRIORS.items():
        for k, v in table.items():
            base = F.when((group == g) & (kind == k), F.lit(v)).otherwise(base)
    base = F.when((kind == "world") & room_shell, F.greatest(base, F.lit(0.90))).otherwise(base)
    base = F.when(kind.isin("intrinsic", "addressee") & (front_confidence < MIN_FRONT_CONFIDENCE), base * 0.35).otherwise(base)
    return base + F.coalesce(cue_weight, F.lit(0.0)) * 10.0


def group_of(relation: Column) -> Column:
    out = F.lit(None).cast("string")
    for r, g in GROUPS.items():
        out = F.when(relation == r, F.lit(g)).otherwise(out)
    return out


def position(kind: Column, group: Column) -> Column:
    """The place of a kind in its group's table, which breaks ties of priors."""
    out = F.lit(9)
    for g, table in PRIORS.items():
        for i, k in enumerate(table):
            out = F.when((group == g) & (kind == k), F.lit(i)).otherwise(out)
    return out


def usable(has_cue: Column) -> Column:
    """Whether a frame (available, confidence) may be chosen: confidence counts only where the sentence says nothing."""
    return F.col("available") & (has_cue | (F.col("confidence") >= MIN_USABLE_CONFIDENCE))


def landmark_eye(x: Column, y: Column, floor: Column, to_x: Column, to_y: Column) -> tuple[Column, Column, Column]:
    """A viewer at a landmark: at eye height, a quarter metre towards the anchor."""
    ix, iy = horizontal(to_x - x, to_y - y)
    return x + ix * 0.25, y + iy * 0.25, floor + EYE_HEIGHT
