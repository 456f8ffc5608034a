"""What a Python worker keeps between stages, and shuffle files that a step leaves."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from lakequill.llm import bpe, common, toxicity


def test_worker_lets_go_of_the_encoders_before():
    b = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(600)])], names=["text"])
    bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))
    parts = list(toxicity.slices(iter([b, b])))
    assert [p.num_rows for p in parts] == [256, 256, 88] * 2
    assert [t for p in parts for t in p.column(0).to_pylist()] == [str(i) for i in range(600)] * 2
    assert bpe.encoder.cache_info().currsize == 0


def test_checkpoint_leaves_no_shuffle_files(spark):
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = shuffles()
    out = common.checkpointed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert sum(r["count"] for r in out.collect()) == 1000
    assert shuffles() <= before
