"""The parser as a table function: distinct texts are parsed once, in Arrow batches, and joined back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V

SCHEMA = "text string, target string, relation string, relation_type string, anchor string, anchor2 string, frame_hint string, viewpoint_hint string, size_word string, superlative string, ordinal_word string, ordinal_index long, from_word string, from_landmark string, level_word string, attributes array<string>, plural boolean, phrases int, confidence double"


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from ..functions.parser import parse

    for f in frames:
        out = []
        for text in f["text"]:
            q = parse(text)
            t, a = q.chain[0], q.chain[1] if len(q.chain) > 1 else None
            counted = t.ordinal_word is not None
            out.append(
                (text, t.label, t.relation, q.relation_type, a and a.label, a.second.label if a and a.second else None, q.frame_hint, q.viewpoint_hint, t.size_word, t.superlative,
                 t.ordinal_word, t.ordinal_index, t.from_word if counted else None, t.from_landmark, t.level_word, t.attributes, t.plural, len(q.chain), q.confidence)
            )
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"ordinal_index": "Int64"})


def parsed(queries: DataFrame) -> DataFrame:
    """queries (query_id, text) with what the parser makes of the text."""
    once = queries.select("text").distinct().mapInPandas(_rows, SCHEMA)
    return queries.join(once, "text")


def with_parser(queries: DataFrame, parser, schema: str) -> DataFrame:
    """As parsed, with a parser of the caller's: a function from frames with a column text to frames of the schema."""
    return queries.join(queries.select("text").distinct().mapInPandas(parser, schema), "text")


def relation_of(form: Column) -> Column:
    """A surface form's relation, as it is or without its prefix, suffix or both."""
    from . import lookup

    return lookup.relation_of(form)


def trim_noun_phrase(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(text), rf"^.*\b(?:{'|'.join(V.STOPS)})\b ?", ""), " "), lambda w: w != "")
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), F.lit(3)), " ")


def colour_score(wanted: Column, r: Column, g: Column, b: Column) -> Column:
    """Best agreement of a colour with any of the wanted colour words; 1 if none is one, at least 0.05 else."""
    table = V.colours()
    known = F.filter(wanted, lambda w: w.isin(*table))
    parts = [F.create_map(*[F.lit(v) for w, rgb in table.items() for v in (w, rgb[i])]) for i in range(3)]

    def near(w: Column) -> Column:
        d = [c - F.element_at(p, w) for c, p in zip((r, g, b), parts, strict=True)]
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / F.sqrt(F.lit(3.0)) / 0.55))

    return F.when(F.size(known) == 0, 1.0).otherwise(F.greatest(F.lit(0.05), F.array_max(F.transform(known, near))))
