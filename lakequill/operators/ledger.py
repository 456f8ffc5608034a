"""Keyed ledgers: idempotent upserts, state machines and checks, as joins and grouped folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(ledger: DataFrame, incoming: DataFrame, key: str, merge: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Full outer join on the key; ``merge`` gives for each column (value where the key was there, value where it is new)."""
    old, new = ledger.alias("old"), incoming.alias("new")
    j = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    there = F.col(f"old.{key}").isNotNull()
    return j.select(F.coalesce(f"old.{key}", f"new.{key}").alias(key), *[F.when(there, a).otherwise(b).alias(c) for c, (a, b) in merge.items()])


def refresh_state(state: Column, in_debt: Column) -> Column:
    """New debt is pending, done debt comes back, open work without debt is done; what was skipped or blocked stays."""
    return (
        F.when(state.isNull() & in_debt, "pending")
        .when((state == "done") & in_debt, "pending")
        .when(state.isin("pending", "in_progress") & ~in_debt, "done")
        .otherwise(state)
    )


def blocked_after(events: DataFrame, key: str, order: list[str], verdict: str, limit: int = 3) -> DataFrame:
    """``(key, state, rejections)``: the last verdict, or blocked from ``limit`` rejections on."""
    last = F.max_by(F.col(verdict), F.struct(*order))
    agg = events.groupBy(key).agg(last.alias("last"), F.count_if(F.col(verdict) == "rejected").alias("rejections"))
    return agg.select(key, F.when(F.col("rejections") >= limit, "blocked").otherwise(F.col("last")).alias("state"), "rejections")


def missing_both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def finding(df: DataFrame, check: str, severity: str, key: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("subject"))
