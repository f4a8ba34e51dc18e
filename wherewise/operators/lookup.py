"""Look-ups of surface forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import literal_map


def relation_of(form: Column) -> Column:
    known = literal_map({f: r for r, (_, _, more) in V.relations().items() for f in (r, *more)})
    s = F.trim(F.regexp_replace(F.translate(F.lower(form), "-_", "  "), r"\s+", " "))

    def head(x: Column) -> Column:
        out = x
        for p in reversed(V.FORM_PREFIXES):
            out = F.when(x.startswith(p), F.trim(F.substr(x, F.lit(len(p) + 1)))).otherwise(out)
        return out

    def tail(x: Column) -> Column:
        out = x
        for e in reversed(V.FORM_SUFFIXES):
            out = F.when(x.endswith(e) & (F.length(x) > len(e) + 1), F.trim(F.left(x, F.length(x) - len(e)))).otherwise(out)
        return out

    return F.coalesce(*[F.element_at(known, c) for c in (s, head(s), tail(s), tail(head(s)), head(tail(s)))])
