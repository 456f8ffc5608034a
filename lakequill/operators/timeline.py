"""Day-granular timelines: births, cumulative and daily series, replay and difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def day(text: Column | str) -> Column:
    """Epoch day of the first ten characters, null if they are no date."""
    return F.unix_date(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def days_since(date: Column | str, as_of: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.datediff(as_of, date)), F.lit(10_000))


def cumulative(events: DataFrame, day_col: str, by: list[str] | None = None) -> DataFrame:
    """``(by.., day, daily, cum)`` on every active day of the whole input. Counts are pre-aggregated, so a window sees days, not rows.

    Groups have a row on each active day, with a count of nought where nothing happened.
    """
    by = by or []
    counts = events.groupBy(*by, F.col(day_col).alias("day")).agg(F.count("*").alias("daily"))
    if by:
        grid = counts.select(*by).distinct().join(counts.select("day").distinct())
        counts = grid.join(counts, [*by, "day"], "left").withColumn("daily", F.coalesce("daily", F.lit(0)))
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("cum", F.sum("daily").over(w))


def replay_class(born: Column, at: Column, window: int) -> Column:
    """hidden after ``at``, new within ``window`` days before it, else existing."""
    return F.when(born.isNull() | (born > at), "hidden").when(born > at - window, "new").otherwise("existing")


def diff_class(born: Column, updated: Column, a: Column, b: Column) -> Column:
    """new if born in (a, b], updated if changed in it, else unchanged; hidden if born later."""
    return F.when(born > b, "hidden").when(born > a, "new").when((updated > a) & (updated <= b), "updated").otherwise("unchanged")


def iso_timestamp(raw: Column | str) -> Column:
    """An ISO date and time, with ``Z``, an offset with or without a colon, or without a zone (then in the session's); else null."""
    r = F.trim(raw)
    whole = r.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})?$")
    return F.when(whole, F.try_to_timestamp(F.regexp_replace(r, r"([+-]\d{2})(\d{2})$", "$1:$2")))
