"""Contiguous balanced shards from global byte-size prefix sums, in DataFrame operations only.

Documents are range-partitioned by id; each partition sorts and sums its own sizes; the totals, one
row per partition, give every partition its offset; and the prefix sums are cut at equal targets.

Defined cases: a null text has no bytes, so size 1; rows with one id are told apart by size and
checksum, and fully equal rows are interchangeable; a null id sorts first; an empty table gives no
rows; other columns are not read. Fewer rows than shards leave some shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.llm.common import checkpointed


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)``; shard k holds the documents whose middle byte lies in the k-th of equal spans.

    Only key, size and checksum are moved. A shard's size misses the target by less than one document on either side.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(key, (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    # kept once, so that the totals and the sums inside a partition see the same cut whatever is run again
    sized = checkpointed(sized.repartitionByRange(parts, key, "size", "text_crc32").withColumn("part", F.spark_partition_id()))
    totals = sized.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row per partition: a fixed number whatever the number of documents
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy(key, "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        sized.withColumn("upto", F.sum("size").over(inside))
        .withColumn("row", F.row_number().over(W.partitionBy("part").orderBy(key, "size", "text_crc32")))
        .join(F.broadcast(offsets), "part")
        .withColumn("row", F.col("rows_before") + F.col("row") - 1)
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, ((bytes_before + upto) * 2 - size) * {shards} div (2 * all_bytes)) as int)"))
    )
    # rows run on from shard to shard, so the first of a shard is the number of rows in those before it
    counts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(counts), "shard").select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
