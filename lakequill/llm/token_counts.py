"""Token counts by a separator scan over flat, unindexed token files.

A flat file is nothing but 16-bit ids with an end-of-document id after each document. It is cut into
blocks at any byte; each block is searched on its own with one vectorised comparison, and the lengths
at block edges are stitched by a prefix scan over one small row per block.

Defined cases: a null text is empty and counts no tokens; a block without a separator, a document over
many blocks, separators side by side and tokens after the last separator (``ended`` false) are all
counted; an empty table gives no rows. Repeated rows are counted each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.llm.bpe import encoder
from lakequill.llm.common import checkpointed

BLOCK_TOKENS = 1 << 19


def token_files(docs: DataFrame, path: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents of each task as one flat token file, in blocks: ``(file, block, data binary, doc_ids)``.

    ``doc_ids`` is the list that goes with a file: the documents that end in the block, in order. The
    text of special tokens is ordinary text here, so that the end id stands at ends only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, file = encoder(path), np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId()
        parts: list[bytes] = []
        size, block, ends, done = 0, 0, [], 0  # ends: (token position after the document, id)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, size, block, ends, done
            flat = b"".join(parts)
            lo = 0
            while len(flat) - lo >= 2 * block_tokens or last and lo < len(flat):
                data = flat[lo : lo + 2 * block_tokens]
                lo, done = lo + len(data), done + len(data) // 2
                n = next((k for k, (at, _) in enumerate(ends) if at > done), len(ends))
                ids, ends = [x for _, x in ends[:n]], ends[n:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))],
                    names=["file", "block", "data", "doc_ids"],
                )
                block += 1
            parts, size = [flat[lo:]], len(flat) - lo

        for b in batches:
            keys = b.column(0).to_pylist()
            for key, ids in zip(keys, bpe.encode_many([t or "" for t in b.column(1).to_pylist()], special=False), strict=True):
                flat = np.frombuffer(ids, "<u4").astype("<u2").tobytes() + end
                parts.append(flat)
                size += len(flat)
                ends.append((done + size // 2, key))
                if size >= 2 * block_tokens:
                    yield from cut(False)
        yield from cut(True)

    return docs.select("doc_id", "text").mapInArrow(run, "file long, block long, data binary, doc_ids array<long>")


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files on any store that Spark reads, cut into blocks: ``(file string, block, data)``."""
    files = spark.read.format("binaryFile").load(path)
    step = 2 * block_tokens
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / step)).cast("int"))
    return files.select(F.col("path").alias("file"), F.posexplode(F.transform(blocks, lambda i: F.substring("content", i * step + 1, F.lit(step)))).alias("block", "data"))


def separator_scan(blocks: DataFrame, end_id: int) -> DataFrame:
    """Per block: tokens, lengths of the runs before each separator (first one open to the left), and the open rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, lens, rest = [], [], []
            for data in b.column(b.schema.get_field_index("data")).to_pylist():
                ids = np.frombuffer(data, "<u2")
                at = np.flatnonzero(ids == end_id)
                sizes.append(len(ids))
                lens.append(np.diff(at, prepend=-1) - 1)
                rest.append(len(ids) - 1 - at[-1] if len(at) else len(ids))
            cols = [c for name, c in zip(b.schema.names, b.columns, strict=True) if name != "data"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(lens, pa.list_(pa.int64())), pa.array(rest, pa.int64())], names=names)

    kept = [f"{n} {t}" for n, t in blocks.dtypes if n != "data"]
    names = [*(c.split()[0] for c in kept), "tokens", "runs", "rest"]
    return blocks.mapInArrow(run, ", ".join([*kept, "tokens long", "runs array<long>", "rest long"]))


def stitch(scanned: DataFrame) -> DataFrame:
    """Prefix scan over the blocks of each file: adds ``first`` (ordinal of the first document that ends in the
    block), ``start`` (tokens of the file before the block) and ``carry`` (tokens that the first one has already)."""
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    n = F.size("runs")
    return (
        scanned.withColumn("island", F.sum(F.when(n > 0, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("open", F.sum("rest").over(W.partitionBy("file", "island").orderBy("block").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0)))
        .withColumn("first", F.coalesce(F.sum(n).over(before), F.lit(0)))
        .withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("last", F.lead("block").over(order).isNull())
    )


def document_counts(blocks: DataFrame, end_id: int) -> DataFrame:
    """``(file, ordinal, n_tokens, ended, [doc_id])`` for every document of the files."""
    stitched = stitch(checkpointed(separator_scan(blocks, end_id)))
    named = "doc_ids" in stitched.columns
    runs = F.transform("runs", lambda x, i: x + F.when(i == 0, F.col("carry")).otherwise(0))
    ended = stitched.select("file", "first", *(["doc_ids"] if named else []), F.posexplode(runs).alias("i", "n_tokens")).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"), *([F.col("doc_ids")[F.col("i")].alias("doc_id")] if named else [])
    )
    rest = stitched.where("last and open > 0").select(
        "file", (F.col("first") + F.size("runs")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended"), *([F.lit(None).cast("long").alias("doc_id")] if named else [])
    )
    return ended.unionByName(rest)
