"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Base spans (assign, access, hex) come from the contract's patterns: leftmost, non-overlapping by kind; matches that fail their
test are dropped without retries.

Candidates are runs of at least WIDTH characters of [A-Za-z0-9+/_=-] with letters and digits, or with a capital behind a small
letter. A candidate belongs to the narrowest class that holds it (hex, alnum, base64), each with a threshold of its own. A
window of WIDTH characters slides over it: counts of characters change by the one that enters and the one that leaves, and the
sum of c log2 c with them, so the entropy log2 WIDTH - sum / WIDTH costs the same at each step. From the first to the last
window at or above the threshold is a span of kind entropy, unless an allow-list pattern holds the whole candidate or a
base span covers it. Windows that lie by half or more in harmless parts (alphabets, rows of digits, integrity values) don't count,
so what stands beside such a part is still judged.

Only DataFrame operations. Cases: a null text is an empty one (no spans). Positions are code points, ends exclusive. Repeated
rows are returned as they are. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .spans import SPANS, guarded, let, merged, no_spans, ordered, replaced, spans_of

# fixed values of the contract, with linear-time equivalents
_NAME = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = _NAME + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: What stands before the value of an assignment; the value is what remains.
ASSIGN_HEAD = "^" + _NAME + r"""["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")

#: Characters of the window, and thresholds in bits by class.
WIDTH = 20
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.9}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: A part of a path that looks like a word: short, in one case or with one capital. Longer ones are judged by entropy.
_PART = r"(?=[A-Za-z]{1,15}(?![A-Za-z]))(?:[A-Z]+|[a-z]*[A-Z]?[a-z]*)"
#: Harmless candidates of high entropy: UUIDs and paths of words.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rf"^[/_=-]*+(?:{_PART}[/_=-]++)*+{_PART}[0-9]{{0,4}}$",  # possessive: no recursion over the parts of a long path
)
#: Harmless parts of candidates: alphabets with rows of digits, integrity values.
HARMLESS = r"(?:(?i:abcdefghijklmnop(?:qrstuvwxyz)?)|0123456789)+|^sha(?:256-[A-Za-z0-9+/_-]{43}|384-[A-Za-z0-9+/_-]{64}|512-[A-Za-z0-9+/_-]{86})=*"


def base_spans(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    named = F.contains(low, F.lit("pass")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    value = lambda s: F.regexp_replace(s["value"], ASSIGN_HEAD, "")
    return {
        "assign": guarded(named, text, ASSIGN, "assign", lambda s: F.char_length(value(s)) >= 6),
        "access": guarded(F.contains(text, F.lit("AKIA")), text, ACCESS, "access", lambda s: F.lit(True)),
        "hex": guarded(text.rlike(HEX), text, HEX, "hex", lambda s: F.lit(True)),
    }


#: What one bit counts in the fixed-point sums of c log2 c.
_BIT = 1 << 40


def _slide(value: Column, width: int, masked: Column | None, zero: Callable[[Column, Column, Column], Column], step: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """Folds all windows of a string from left to right. zero(sum, harmless, i) and step(state, sum, harmless, i) make what is kept: sum is
    that of c log2 c in _BIT-ths, harmless the number of characters of the window that masked shows as "!"."""
    n = len(ALPHABET)
    clogc = F.array(*[F.lit(0 if c < 2 else round(c * math.log2(c) * _BIT)).cast("long") for c in range(width + 2)])
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    marks = F.transform(F.split(value if masked is None else masked, ""), lambda c: F.when(c == "!", 1).otherwise(0))

    def run(x: Column) -> Column:
        first = F.slice(x["codes"], 1, width)
        counts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.size(F.filter(first, lambda c: c == j)))

        def start(s: Column) -> Column:
            total = F.aggregate(s, F.lit(0).cast("long"), lambda acc, c: acc + F.get(x["clogc"], c))
            bad = F.aggregate(F.slice(x["marks"], 1, width), F.lit(0), lambda acc, m: acc + m)
            return let(F.struct(total.alias("total"), bad.alias("bad")), lambda t: F.struct(s.alias("counts"), t["total"].alias("total"), t["bad"].alias("bad"), zero(t["total"], t["bad"], F.lit(0)).alias("kept")))

        def move(acc: Column, i: Column) -> Column:
            gone, come = F.get(x["codes"], i), F.get(x["codes"], i + width)
            bad = acc["bad"] - F.get(x["marks"], i) + F.get(x["marks"], i + width)

            def changed(m: Column) -> Column:
                # after the one that leaves, then after the one that enters
                total = acc["total"] - F.get(x["clogc"], m["g"]) + F.get(x["clogc"], m["g"] - 1) - F.get(x["clogc"], m["c"]) + F.get(x["clogc"], m["c"] + 1)
                moved = F.when(m["gone"] == m["come"], acc["counts"]).otherwise(F.transform(acc["counts"], lambda v, j: v - F.when(j == m["gone"], 1).otherwise(0) + F.when(j == m["come"], 1).otherwise(0)))
                return let(total, lambda t: F.struct(moved.alias("counts"), t.alias("total"), m["bad"].alias("bad"), step(acc["kept"], t, m["bad"], i + 1).alias("kept")))

            return let(F.struct(gone.alias("gone"), come.alias("come"), bad.alias("bad"), F.get(acc["counts"], gone).alias("g"), (F.get(acc["counts"], come) - F.when(gone == come, 1).otherwise(0)).alias("c")), changed)

        steps = F.when(F.size(x["codes"]) > width, F.sequence(F.lit(0), F.size(x["codes"]) - width - 1)).otherwise(F.array().cast("array<int>"))
        return let(counts, lambda s: F.aggregate(steps, start(s), move, lambda acc: acc["kept"]))

    return let(F.struct(codes.alias("codes"), marks.alias("marks"), clogc.alias("clogc")), run)


def window_entropy(value: Column, width: int = WIDTH) -> Column:
    """Array of the entropies of all windows of a string (of moderate length), by incremental counts."""
    entropy = lambda total: F.lit(math.log2(width)) - total / float(_BIT * width)
    return _slide(value, width, None, lambda total, bad, i: F.array(entropy(total)), lambda kept, total, bad, i: F.concat(kept, F.array(entropy(total))))


def _high_range(value: Column, masked: Column, limit: Column) -> Column:
    """(first, last) numbers of the windows that reach the limit and lie by more than half outside harmless parts; -1 if none does."""
    most = F.floor((F.lit(math.log2(WIDTH)) - limit) * float(WIDTH * _BIT)).cast("long")

    def ranged(x: Column) -> Column:
        high = lambda total, bad: (total <= x["most"]) & (2 * bad < WIDTH)
        zero = lambda total, bad, i: let(F.when(high(total, bad), 0).otherwise(-1), lambda v: F.struct(v.alias("first"), v.alias("last")))
        step = lambda kept, total, bad, i: F.when(high(total, bad), F.struct(F.when(kept["first"] < 0, i).otherwise(kept["first"]).alias("first"), i.alias("last"))).otherwise(kept)
        return _slide(x["value"], WIDTH, x["masked"], zero, step)

    return let(F.struct(value.alias("value"), masked.alias("masked"), most.alias("most")), ranged)


def _masked(value: Column) -> Column:
    """The value with "!" for every character of its harmless parts."""
    parts = F.struct(F.regexp_extract_all(value, F.lit(HARMLESS), F.lit(0)).alias("found"), F.split(value, HARMLESS, -1).alias("between"))
    return let(parts, lambda p: F.array_join(F.transform(p["between"], lambda b, i: F.concat(b, F.repeat(F.lit("!"), F.coalesce(F.char_length(F.get(p["found"], i)), F.lit(0))))), ""))


def entropy_spans(text: Column) -> Column:
    """Spans of kind entropy: of each candidate that no allow-list pattern holds, from the first to the last window above the threshold
    that lies by more than half outside harmless parts."""
    allowed = "|".join(f"(?:{p})" for p in ALLOWED)
    mixed = lambda v: (v.rlike("[0-9]") & v.rlike("[A-Za-z]")) | v.rlike("[a-z][A-Z]")
    telling = F.filter(spans_of(text, CANDIDATE, "entropy"), lambda s: mixed(s["value"]) & ~s["value"].rlike(allowed))
    limit = lambda v: F.when(v.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$"), THRESHOLDS["hex"]).when(v.rlike("^[A-Za-z0-9]++$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])

    def narrow(s: Column) -> Column:
        def cut(r: Column) -> Column:
            start, end = s["start"] + r["first"], s["start"] + r["last"] + WIDTH
            value = F.when(r["first"] >= 0, F.substring(s["value"], r["first"] + 1, r["last"] - r["first"] + WIDTH))
            return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit("entropy").alias("kind"), value.alias("value"))

        return let(_high_range(s["value"], _masked(s["value"]), limit(s["value"])), cut)

    found = F.filter(F.transform(telling, narrow), lambda s: s["value"].isNotNull())
    return F.when(text.rlike(CANDIDATE), found).otherwise(no_spans()).cast(SPANS)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of spans), by kind n_*, entropy (array of spans that no base span covers), redacted (the text with all spans
    replaced by [SECRET]; null where there are none). One row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    rows = rows.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()], entropy_spans(F.col("text")).alias("found"))
    rows = rows.select("doc_id", "text", ordered(F.concat(*KINDS), KINDS).alias("base"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], "found")
    rows = rows.withColumn("entropy", F.filter("found", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))))
    return rows.select("doc_id", "base", *[f"n_{k}" for k in KINDS], "entropy", redacted(F.col("text"), F.concat("base", "entropy")).alias("redacted"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with [SECRET] for what spans cover; overlapping ones become one. Null without spans."""
    return F.when(F.size(spans) > 0, replaced(text, merged(spans), lambda s: F.lit("[SECRET]")))
