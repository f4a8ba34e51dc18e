"""Systems under test behind one protocol, and parses that a model proposes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V


class Probe(Protocol):
    """A system that answers prompts."""

    name: str
    is_control: bool

    def answers(self, prompts: DataFrame) -> DataFrame:
        """query_id and answer (null if it has none) for rows with query_id, prompt and key."""


class FileProbe:
    """Answers that were given elsewhere, filed under the digests of prompts."""

    is_control = False

    def __init__(self, name: str, filed: DataFrame):
        self.name, self.filed = name, filed.select("key", "answer")

    def answers(self, prompts: DataFrame) -> DataFrame:
        return prompts.join(self.filed, "key", "left").select("query_id", "answer")


class FunctionProbe:
    """A function from prompt to reply, called once for each distinct prompt; what it raises is kept as an error, not thrown."""

    is_control = False

    def __init__(self, name: str, ask: Callable[[str], str]):
        self.name, self.ask = name, ask

    def replies(self, prompts: DataFrame) -> DataFrame:
        ask = self.ask

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for p in f["prompt"]:
                    try:
                        out.append((p, ask(p), None))
                    except Exception as e:  # noqa: BLE001 - a model's failure is a result
                        out.append((p, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["prompt", "reply", "error"])

        return prompts.join(prompts.select("prompt").distinct().mapInPandas(run, "prompt string, reply string, error string"), "prompt")

    def answers(self, prompts: DataFrame) -> DataFrame:
        from .evaluation import reply_id

        return self.replies(prompts).select("query_id", reply_id(F.col("reply")).alias("answer"))


def proposed_parse(reply: F.Column) -> F.Column:
    """A parse out of a model's JSON reply: target, relation and anchor; relations that don't exist are dropped."""
    v = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    relation = get("relation")
    return F.struct(get("target").alias("target"), F.when(relation.isin(*V.relations()), relation).alias("relation"), get("anchor").alias("anchor"))
