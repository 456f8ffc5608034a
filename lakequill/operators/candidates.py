"""A ledger of cited references that are not yet read: mentions, decisions, states, and what is ready.

What the ledger keeps are least and greatest values by key, so that batches may come in any order, in any cut, and
more than once: ``fold`` of the batches is ``fold`` of all rows. A key that very many rows mention is summed before
it is shuffled, and its sources stay rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sources that must mention a reference before it is ready, lines of a report, decisions.
DEMAND, LISTED = 2, 30
MARK, REJECT, REOPEN = "mark", "reject", "reopen"


def fold_mentions(rows: DataFrame) -> DataFrame:
    """``(key, source, first_at, last_at)``: one mention for each source and key of ``rows(key, source, first_at, last_at)``. Rows without key, source or time are left out."""
    full = rows.where("key is not null and source is not null and first_at is not null and last_at is not null")
    return full.groupBy("key", "source").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def decided(rows: DataFrame) -> DataFrame:
    """``(key, closed, reopened)`` of single decisions ``rows(key, at, seq, what)``, each as a row of the ledger. What is no decision is left out."""
    full = rows.where("key is not null and at is not null and seq is not null").where(F.col("what").isin(MARK, REJECT, REOPEN))
    closes = F.col("what") != REOPEN
    when = F.struct("at", "seq", "what")
    return full.select("key", F.when(closes, when).alias("closed"), F.when(~closes, when).alias("reopened"))


def fold_decisions(rows: DataFrame) -> DataFrame:
    """``(key, closed, reopened)``: the last mark or rejection and the last reopening of each key. By time, then number."""
    return rows.groupBy("key").agg(F.max("closed").alias("closed"), F.max("reopened").alias("reopened"))


def ledger(mentions: DataFrame, decisions: DataFrame, index: DataFrame) -> DataFrame:
    """``(key, demand, state, first_seen, last_seen, resolved_at)`` of folded mentions and decisions, and ``index(key)`` of what has been read.

    The last mark or rejection holds; one before the first mention has nothing to decide on. A reopening undoes a
    rejection before it and nothing else. What the index holds is ingested unless it is rejected; without a decision
    it is so since it was last seen.
    """
    seen = mentions.groupBy("key").agg(F.count("*").alias("demand"), F.min("first_at").alias("first_seen"), F.max("last_at").alias("last_seen"))
    known = seen.join(decisions, "key", "left").join(index.select("key", F.lit(True).alias("held")).where("key is not null").distinct(), "key", "left")
    last = F.when(F.col("closed.at") >= F.col("first_seen"), F.col("closed"))
    undone = (last["what"] == REJECT) & (F.struct(F.col("reopened.at"), F.col("reopened.seq")) > F.struct(last["at"], last["seq"])) & F.col("reopened").isNotNull()
    told = known.withColumn("last", F.when(~F.coalesce(undone, F.lit(False)), last))
    state = F.when(F.col("last.what") == REJECT, "rejected").when(F.col("held") | (F.col("last.what") == MARK), "ingested").otherwise("pending")
    told = told.withColumn("state", state)
    resolved = F.when(F.col("state") != "pending", F.coalesce("last.at", "last_seen"))
    return told.select("key", "demand", "state", "first_seen", "last_seen", resolved.alias("resolved_at"))


def ready(states: DataFrame) -> DataFrame:
    """Pending references that enough sources mention."""
    return states.where((F.col("state") == "pending") & (F.col("demand") >= DEMAND)).select("key", "demand")


def extracted(found: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """``(key, ident)``: identifiers ``found(key, ident)`` in a document, without those that are the document's ``own(key, ident)``, stamps among them."""
    return found.distinct().join(own.select(key, "ident").distinct(), [key, "ident"], "left_anti")
