"""Structured Streaming over the events table: an extension, as the studied engine has no streams.

Each function takes a streaming (or batch) DataFrame of events; run() drives a bounded stream to its end and returns what it wrote, arrivals()
does so for parts that come one after another. Events without a time are in no window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import scratch


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder as a stream; events.parquet is a file or a folder of files, which a pattern as the path both allows."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")


def timed(events: DataFrame) -> DataFrame:
    """Event times as instants, with ten minutes for late rows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")


def start_of(window: str):
    return F.col(f"{window}.start").cast("timestamp_ntz").alias("start")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return timed(events).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(start_of("window"), "event_type", "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    w = F.window("ts", width, step)
    return timed(events).groupBy(w).agg(F.count("*").alias("n")).select(start_of("window"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return timed(events).groupBy(w, "user_id").agg(F.count("*").alias("n")).select(start_of("session_window"), "user_id", "n")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each user."""
    return events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


def _drive(df: DataFrame, mode: str, out: str, state: str) -> None:
    """Runs a stream to the end of what is there. Each batch replaces the folder of its number, so one that is run again after a failure leaves no
    row twice; nothing passes through the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def _read(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """What batches left; nothing if there was none."""
    try:
        return spark.read.schema(schema).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run(df: DataFrame) -> DataFrame:
    """Processes all that is there and returns the result table."""
    folder = scratch(df.sparkSession)
    _drive(df, "complete", f"{folder}/out", f"{folder}/state")
    return _read(df.sparkSession, f"{folder}/out", df.schema)


def arrivals(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The updates of make(stream) when parts arrive one after another. Between them the stream is stopped and taken up again from its stored
    state, watermark included; rows of a part that are older than the watermark that its predecessors set are dropped."""
    spark, folder = parts[0].sparkSession, scratch(parts[0].sparkSession)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        updates = make(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in"))
        _drive(updates, "update", f"{folder}/out", f"{folder}/state")
    return _read(spark, f"{folder}/out", updates.schema)
