"""Positions of pattern matches with DataFrame functions only.

split() and regexp_extract_all() with one pattern give what is between matches and the matches; their lengths in code points add
up to positions. Sums run in blocks of about the square root of the number of matches, since a fold that grows an array copies
it at every step. Patterns must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is computed once; a Column used in a lambda is otherwise computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of integers what combine (associative, with 0 as its zero) makes of those before it."""
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def grow(acc: Column, v: Column) -> Column:
        return F.struct(combine(acc["at"], v).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def blocked(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x["all"]))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["all"]) - 1) / width).cast("int")), lambda k: F.aggregate(F.slice(x["all"], k * width + 1, width), zero, grow))
        first = lambda b: F.aggregate(F.transform(b, lambda y: y["at"]), zero, grow, lambda acc: acc["out"])
        return let(blocks, lambda b: let(first(b), lambda f: F.flatten(F.transform(b, lambda y, k: F.transform(y["out"], lambda v: combine(v, F.get(f, k)))))))

    return let(F.struct(values.alias("all")), lambda x: F.when(F.size(x["all"]) == 0, none).otherwise(blocked(x)))


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, value) of all matches, in order."""

    def place(x: Column) -> Column:
        gaps = F.transform(x["found"], lambda v, i: F.char_length(F.get(x["between"], i)))
        whole = F.transform(x["found"], lambda v, i: F.char_length(v) + F.char_length(F.get(x["between"], i)))

        def spans(y: Column) -> Column:
            return F.transform(
                x["found"],
                lambda v, i: let(
                    F.get(y["before"], i) + F.get(y["gaps"], i),
                    lambda start: F.struct(start.cast("int").alias("start"), (start + F.char_length(v)).cast("int").alias("end"), F.lit(kind).alias("kind"), v.alias("value")),
                ),
            )

        return F.when(F.size(x["found"]) == 0, no_spans()).otherwise(let(F.struct(gaps.alias("gaps"), running(whole, lambda a, b: a + b).alias("before")), spans))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")), place)


def replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """The text with spans (sorted by start, apart from each other) replaced by put(span)."""

    def pieces(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        end = lambda i: F.when(i == 0, 0).otherwise(F.get(x, i - 1)["end"])

        def block(y: Column) -> Column:
            before = lambda i: F.when(i == 0, y["from"]).otherwise(F.get(y["part"], i - 1)["end"])
            return F.array_join(F.transform(y["part"], lambda s, i: F.concat(F.substring(y["region"], before(i) - y["from"] + 1, s["start"] - before(i)), put(s))), "")

        # counting characters starts at the front of a string, so each block of spans has its own stretch of the text cut out first
        part = lambda k: F.slice(x, k * width + 1, width)
        region = lambda k: F.substring(text, end(k * width) + 1, F.element_at(part(k), -1)["end"] - end(k * width))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda k: let(F.struct(part(k).alias("part"), end(k * width).alias("from"), region(k).alias("region")), block))
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.element_at(x, -1)["end"] + 1, F.char_length(text)))

    return let(spans, lambda x: F.when(F.size(x) == 0, text).otherwise(pieces(x)))


def merged(spans: Column, *fields: str) -> Column:
    """(start, end, fields of the first) of what spans cover, sorted; overlapping ones become one."""
    flat = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", *fields)])))

    def groups(x: Column) -> Column:
        most = F.array_max(F.transform(x, lambda s: s["end"]))

        def heads(y: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["start"] >= F.get(y["before"], i)))
            # the furthest end before the next group, or of all
            return let(at, lambda h: F.transform(h, lambda i, k: F.struct(F.get(x, i)["start"].alias("start"), F.coalesce(F.get(y["before"], F.get(h, k + 1)), y["most"]).alias("end"), *[F.get(x, i)[f].alias(f) for f in fields])))

        return let(F.struct(running(F.transform(x, lambda s: s["end"]), F.greatest).alias("before"), most.alias("most")), heads)

    return let(flat, lambda x: F.when(F.size(x) == 0, F.slice(x, 1, 0)).otherwise(groups(x)))


def guarded(hint: Column, text: Column, pattern: str, kind: str, test: Callable[[Column], Column]) -> Column:
    """Spans that pass the test, looked for only where the cheap hint holds."""
    return F.when(hint, F.filter(spans_of(text, pattern, kind), test)).otherwise(no_spans())


def ordered(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Sorted by start, then kind as listed, then end."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
