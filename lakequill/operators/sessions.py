"""Session logs: de-duplication, gaps, context statistics, tools and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_SECONDS = 300


def gaps(rows: DataFrame, key: str, ts: str, tie: str, seconds: int = GAP_SECONDS) -> DataFrame:
    """``(key, n, gaps, active_seconds)``; the predecessor is the last row with a time. A gap is longer than ``seconds``."""
    w = W.partitionBy(key).orderBy(ts, tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = rows.where(F.col(ts).isNotNull()).withColumn("step", micros - F.lag(micros).over(w))
    long = F.col("step") > seconds * 1_000_000
    return timed.groupBy(key).agg(F.count("*").alias("n"), F.count_if(long).alias("gaps"), F.sum(F.when(~long, F.col("step")).otherwise(0)).alias("active_micros"))


def upper_median(values: Column) -> Column:
    """Element n//2 of the sorted values."""
    s = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def ordered_case(col: Column, table: list[tuple[str, object]], fallback) -> Column:
    """The value of the first key that is part of ``col``."""
    out = F.lit(fallback)
    for k, v in reversed(table):
        out = F.when(F.contains(col, F.lit(k)), F.lit(v)).otherwise(out)
    return out


def runs(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """``(key, value, first, last, length)`` of consecutive rows with one value: gaps and islands by two row numbers."""
    a = F.row_number().over(W.partitionBy(key).orderBy(pos))
    b = F.row_number().over(W.partitionBy(key, value).orderBy(pos))
    return rows.withColumn("island", a - b).groupBy(key, value, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("length")).drop("island")
