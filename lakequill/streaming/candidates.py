"""The ledger of references kept by streams of mentions and decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(rows: DataFrame, fold: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Folds each micro-batch of a stream and writes it to its own part of ``folder``.

    A batch that runs again replaces its part. As folds may be taken in any order, nothing is read back to write.
    """

    def put(batch: DataFrame, number: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, folder: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What all micro-batches left in ``folder``, folded once more."""
    return fold(spark.read.parquet(folder).drop("batch"))


def compact(spark: SparkSession, folder: str, to: str, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Writes the folded parts of ``folder`` as one part of a new folder, ``to``; parts read later may be added there."""
    kept(spark, folder, fold).write.parquet(f"{to}/batch=-1")
