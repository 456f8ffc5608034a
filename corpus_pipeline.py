"""Corpus pipeline: toxicity, line de-duplication, n-gram Jaccard join, packing.

``STAGES`` names the stages in order; each calls one operator of ``lakequill.llm``. ``run`` applies them to
``documents`` one after the other, each stage's result written to the checkpoint folder before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakequill.llm import stages
from lakequill.llm.common import checkpointed, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_lines),
    ("ngram_jaccard", stages.drop_copies),
    ("packing", stages.pack),
]

#: SQL expresses neither the trained machine nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
