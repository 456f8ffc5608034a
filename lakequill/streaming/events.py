"""Structured Streaming forms: inactivity sessions, monthly rotation, de-duplication by id, and a keyed state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "1 hour"


def read(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def inactivity_sessions(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Sessions of a user that a gap of more than ``seconds`` ends; state goes with the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    return timed.groupBy("user_id", F.session_window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_by_id(events: DataFrame) -> DataFrame:
    """The first arrival of each id; ids are kept as long as late ones may come."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def monthly(events: DataFrame) -> DataFrame:
    """Counts by month and type of events that arrive once or more often."""
    return first_by_id(events).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


def rejections(events: DataFrame, limit: int = 3) -> DataFrame:
    """A state per user: blocked once it has ``limit`` rejections; emits the state after each batch that touches the user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for b in batches:
            n += int((b.event_type == "purchase").sum())
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "rejections": [n], "state": ["blocked" if n >= limit else "open"]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, rejections long, state string", "n long", "update", "NoTimeout")


def run_once(df: DataFrame, sink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, batch by batch, into ``sink(frame, batch_id)``."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q
