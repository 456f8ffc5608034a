"""Queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm import bpe_codec, click_windows, line_dedup, media, ngram_join, packing, perspectives, pivot_search, sharding, tiered_bpe, token_alignment, token_counts, toxicity
from lakequill.llm.common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a bitmap without a declared type, sniffed, carved out and read back."""
    return media.digest(media.store_texts(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are the same as, or much like, an earlier one."""
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen contiguous shards of all documents with near-equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's side, turn by turn, with loss masks."""
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, from a machine trained outside the held-out fifth of the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files of all documents."""
    path, end = public_tokenizers.path("word_bpe_49k.json"), 49407
    blocks = token_counts.token_files(table(spark, sf_dir, "documents"), path, end)
    return token_counts.document_counts(blocks, end).select("doc_id", "n_tokens", "file", "ordinal", "ended")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing of all documents into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, packing.WINDOW)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the byte-level vocabulary, and the text they decode to."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bpe_codec.map_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), bpe_codec.digest, schema)


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products for every hundredth vector, against all vectors."""
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, 10)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of the byte-level and the piece vocabulary, with corpus-wide counts of linked ids."""
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of repeated clicks, from ten batches of arrivals fed to a stateful stream."""
    return click_windows.windows(table(spark, sf_dir, "clicks"))


def op13_tiered_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the rank file, and the bytes they decode to."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return tiered_bpe.map_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tiered_bpe.digest, schema)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sharding": op4_sharding,
    "op5_chat_perspectives": op5_chat_perspectives,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_pivot_topk": op9_pivot_topk,
    "op10_bpe": op10_bpe,
    "op11_token_alignment": op11_token_alignment,
    "op12_click_windows": op12_click_windows,
    "op13_tiered_bpe": op13_tiered_bpe,
}
ORACLE_SQL: dict[str, str] = {"op5_chat_perspectives": perspectives.ORACLE, "op9_pivot_topk": pivot_search.ORACLE}
