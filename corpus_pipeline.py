"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing to target weights, byte-level BPE.

Each stage takes what its predecessor kept and is written before the next one reads it. Toxic documents go; of equal texts one
stays; of each group of near copies one stays; the mix takes words of each source up to its target, a document at most twice;
the last stage returns token ids. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wherewise.llm import bpe, exact_dedup, minhash_dedup, mixing, toxicity
from wherewise.llm.common import cut, table
from wherewise.llm.queries import bpe_files

#: Near copies are pairs of 0.8 or more; of 80 equal minima such a pair has 64 on average, and fewer than 38 with odds below 1e-10.
NEAR_PERCENT, NEAR_FLOOR = 80, 38


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup_filter(docs, percent=NEAR_PERCENT, floor=NEAR_FLOOR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(docs, *bpe_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenize),
]

#: SQL can express neither compression lengths nor the pseudorandom choice of blocks; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
