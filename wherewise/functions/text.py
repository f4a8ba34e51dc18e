"""Labels, cleaning and frame cues of English phrases as column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


@cache
def _names() -> dict[str, str]:
    """Classes by every name they have: their own and synonyms (the two never overlap)."""
    return {c: c for c in V.categories()} | V.synonyms()


def _look(table: dict[str, str], key: Column) -> Column:
    return F.element_at(literal_map(table), key)


def label_key(raw: Column) -> Column:
    """Lower case, one of alternatives, letters and digits only, without an article."""
    s = F.trim(F.lower(F.coalesce(raw.cast("string"), F.lit(""))))
    s = F.trim(F.split_part(F.translate(s, "_-", "  "), F.lit("/"), F.lit(1)))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", " "), r"\s+", " "))
    return F.regexp_replace(s, r"^(?:the|a|an|this|that|some)\s+", "")


def class_of(key: Column) -> Column:
    """The class that a key from label_key names: itself, a synonym, a plural, or what its last word names; else the key.

    The key is bound once by a lambda: it is used a dozen times, and repeated it would outgrow a generated method.
    """
    return F.get(F.transform(F.array(key), _class_of), F.lit(0))


def _class_of(key: Column) -> Column:
    names = _names()
    last = F.element_at(F.split(key, " "), -1)
    tail = lambda n: F.left(key, F.length(key) - n)
    return F.when(key == "", "").otherwise(
        F.coalesce(
            _look(names, key),
            _look(V.PLURALS, key),
            F.when(key.endswith("ies") & (F.length(key) > 4), _look(names, F.concat(tail(3), F.lit("y")))),
            F.when(key.endswith("es"), _look(names, tail(2))),
            F.when(key.endswith("s") & ~key.endswith("ss"), _look(names, tail(1))),
            F.when(key.contains(" "), _look(names, last)),
            key,
        )
    )


def label_match(a: Column, b: Column) -> Column:
    """Agreement of two classes: 1 equal, 0.6 same last word, 0.7 compound, 0.5 contained, else 0."""
    last = lambda c: F.element_at(F.split(c, " "), -1)
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(last(a) == last(b), 0.6)
        .when(a.endswith(b) | b.endswith(a), 0.7)
        .when(F.contains(a, b) | F.contains(b, a), 0.5)
        .otherwise(0.0)
    )


def flag(label: Column, name: str) -> Column:
    """A property of a class; false for classes that aren't known."""
    return label.isin(*[c for c, p in V.categories().items() if p[name]])


def clean(text: Column) -> Column:
    """Lower case, plain words, without the first wrapper that matches and without hedges; "on the left" becomes "leftmost"."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    s = F.trim(F.regexp_replace(F.regexp_replace(F.translate(s, "’", "'"), "[^a-z0-9' ]+", " "), r"\s+", " "))
    once = s
    for pattern in reversed(V.WRAPPERS):
        once = F.when(s.rlike(pattern), F.trim(F.regexp_replace(F.regexp_replace(s, pattern, ""), r"\s+", " "))).otherwise(once)
    for hedge in V.HEDGES:
        once = F.regexp_replace(once, rf"\b{hedge}\b", " ")
    once = F.trim(F.regexp_replace(once, r"\s+", " "))
    return F.trim(F.regexp_replace(once, r"\b(?:on|to|at|towards|toward) the (left|right)\b(?!\s+of)", "$1most"))


def cues(text: Column) -> Column:
    """Array of (kind, weight, rule) of frame cues, strongest first; of one kind and rule the first."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))

    def cue(hit: Column, kind: str, weight: float, rule: str, order: int) -> Column:
        return F.when(hit, F.struct(F.lit(-weight).alias("w"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule")))

    some = lambda patterns: F.lit(False) if not patterns else s.rlike("|".join(f"(?:{p})" for p in patterns))
    stop = "|".join(V.STOPS)
    # a possessive counts if words are left behind the last preposition or article
    owner = F.regexp_replace(F.regexp_extract(s, V.POSSESSIVE, 1), rf"^.*\b(?:{stop})\b ?", "")
    stand = s.rlike(V.STAND_CUE)
    found = [
        cue(some([p for p, k in V.VIEWER_CUES if k == "egocentric"]), "egocentric", 1.0, "viewer_phrase", 0),
        cue(some([p for p, k in V.VIEWER_CUES if k == "egocentric_image"]), "egocentric_image", 1.0, "viewer_phrase", 1),
        cue(some(V.INTRINSIC_CUES), "intrinsic", 1.0, "intrinsic_phrase", 2),
        cue(s.rlike(V.POSSESSIVE) & (owner != ""), "intrinsic", 0.9, "possessive", 3),
        cue(some(V.ADDRESSEE_CUES), "addressee", 0.95, "addressee_phrase", 4),
        cue(some(V.WORLD_CUES), "world", 1.0, "world_phrase", 5),
        cue(stand | s.rlike(V.ENTER_CUE), "egocentric", 1.0, "landmark_viewpoint", 6),
        cue(~stand & s.rlike(V.FROM_CUE), "egocentric", 0.8, "landmark_viewpoint_from", 7),
    ]
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda c: F.struct(c["kind"], (-c["w"]).alias("weight"), c["rule"]))


def relation_type(relation: Column) -> Column:
    return F.coalesce(_look(V.TYPES, relation), F.lit("other"))
