"""Registry of the engine's queries: by operator key a function of the tables, and the SQL of the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    # HotSpot interprets methods above 8000 bytes for ever; below that limit Spark splits long expressions into methods that it compiles
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def query(key: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under an operator key."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql:
            SQL[key] = with_tables(sql)
        return f

    return add
