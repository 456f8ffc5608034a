"""Multi-party perspective rotation: every participant's dialogue with that speaker as the assistant.

Each dialogue is given once per participant (its distinct roles but ``system``): the participant's own
turns become assistant turns and carry the loss, all others become named user turns, system turns stay.
The result has a row per dialogue, participant and turn, with the turn's rendered text and its place in
the rendered dialogue, so that a dialogue of any length is never gathered in one task.

Defined cases: a null or blank role counts as ``user``; a null text is empty; turns with one number
keep an order by role and text, equal rows follow one another; rows without a dialogue id form one
dialogue; a dialogue of system turns alone has no perspective; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.llm.common import checkpointed

SYSTEM = "system"
OWN, OTHER, RULES, END = "<|assistant|>\n", "<|user|>", "<|system|>\n", "<|end|>\n"


def rotate(turns: DataFrame) -> DataFrame:
    """``(conv_id, speaker, position, turn, name, learn, piece, start, mask_start, mask_end)``.

    ``start`` is the piece's character offset in the rendered dialogue. The mask spans what is learned
    from, an assistant's text with its end mark, and is empty (start = end) elsewhere. The turns are
    range-partitioned in dialogue order, a long dialogue over many partitions; sums inside a partition
    and over one row per dialogue and partition give the positions and offsets.
    """
    spark = turns.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("user"))
    order = ["conv_id", "turn", "name", "text", "tie"]
    ranged = turns.select("conv_id", "turn", name.alias("name"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    # kept once, so that totals and sums see the same partitions whatever is run again
    ranged = checkpointed(ranged.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    # length of a turn as a named user's or as the system's; as the assistant's it differs by a constant per name
    header = F.when(F.col("name") == SYSTEM, F.lit(len(RULES))).otherwise(F.length("name") + len(OTHER) + 3)
    sized = ranged.withColumn("chars", (header + F.length("text") + len(END)).cast("long"))
    inside = W.partitionBy("part", "conv_id").orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("part", "conv_id", "name").orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = (
        sized.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
        .select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), zero).alias("n_before"), F.coalesce(F.sum("chars").over(earlier), zero).alias("chars_before"))
    )
    placed = (
        sized.withColumn("n_in", F.count("*").over(inside)).withColumn("chars_in", F.coalesce(F.sum("chars").over(inside), zero)).withColumn("own_in", F.count("*").over(own))
        .join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
        .select("conv_id", "turn", "name", "text", "part", (F.col("n_before") + F.col("n_in")).alias("position"), (F.col("chars_before") + F.col("chars_in")).alias("at"), "own_in")
    )
    # own turns of each speaker before each part of the dialogue, for every part
    spoken = sized.where(F.col("name") != SYSTEM).groupBy("conv_id", "name").agg(F.count("*").alias("turns")).select(F.col("conv_id").alias("c"), F.col("name").alias("speaker"))
    said = sized.where(F.col("name") != SYSTEM).groupBy("conv_id", "part", "name").agg(F.count("*").alias("own"))
    grid = totals.select("c", "p").join(spoken.withColumnRenamed("c", "c2"), F.col("c").eqNullSafe(F.col("c2")))
    own_before = (
        grid.join(said, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("part")) & (F.col("speaker") == F.col("name")), "left")
        .select("c", "p", "speaker", F.coalesce(F.sum("own").over(W.partitionBy("c", "speaker").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), zero).alias("own_before"))
    )
    # own turns of each speaker before each turn inside its part
    rotated = placed.join(own_before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    running = W.partitionBy("part", "conv_id", "speaker").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    mine = F.col("name") == F.col("speaker")
    before = F.col("own_before") + F.coalesce(F.sum(F.when(mine, 1).otherwise(0)).over(running), zero)
    start = F.col("at") - before * (F.length("speaker") + len(OTHER) + 3 - len(OWN))
    piece = F.when(mine, F.concat(F.lit(OWN), "text", F.lit(END))).when(F.col("name") == SYSTEM, F.concat(F.lit(RULES), "text", F.lit(END))).otherwise(F.concat(F.lit(OTHER + " "), "name", F.lit(":\n"), "text", F.lit(END)))
    return rotated.select("conv_id", "speaker", "position", "turn", "name", mine.alias("learn"), piece.alias("piece"), start.alias("start")).select(
        "*",
        F.when(F.col("learn"), F.col("start") + len(OWN)).otherwise(F.col("start")).alias("mask_start"),
        F.when(F.col("learn"), F.col("start") + F.length("piece") - 1).otherwise(F.col("start")).alias("mask_end"),
    )


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'user') AS name, coalesce(text, '') AS text FROM conversations
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, text) - 1 AS position FROM t
), s AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> '{SYSTEM}'
), r AS (
  SELECT o.conv_id, speaker, position, turn, name, name = speaker AS learn,
    CASE WHEN name = speaker THEN '{OWN}' || text || '{END}'
         WHEN name = '{SYSTEM}' THEN '{RULES}' || text || '{END}'
         ELSE '{OTHER} ' || name || ':' || chr(10) || text || '{END}' END AS piece
  FROM o JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r
)
SELECT conv_id, speaker, position::BIGINT AS position, turn, name, learn, piece, start,
  CASE WHEN learn THEN start + {len(OWN)} ELSE start END::BIGINT AS mask_start,
  CASE WHEN learn THEN start + length(piece) - 1 ELSE start END::BIGINT AS mask_end
FROM p
"""
