"""Shared helpers of the training-data operators: table access, checkpoints, connected components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own; a cluster gets an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or f"{tempfile.gettempdir()}/lakequill-{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go as soon as it has ended, instead of at some later garbage collection."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of ``spark.checkpoint.dir``, see :func:`checkpoint_folder`. The step's own shuffle files go as soon as it is written."""
    checkpoint_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        # made anew, as the setting counts when a plan is made
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table to the folder of ``spark.checkpoint.dir`` and read back: a checkpoint for wide rows and arrays.

    Its own shuffle files are removed once it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables of :func:`stored` that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def released() -> None:
    """Lets go of the encoders, with the words that they have learnt, that a stage before left in this Python worker, and of freed memory."""
    bpe = sys.modules.get("lakequill.llm.bpe")
    if bpe and bpe.encoder.cache_info().currsize:
        bpe.encoder.cache_clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def nodes_of(edges: DataFrame) -> DataFrame:
    """``(w)``: the nodes that hang on a smaller one."""
    return edges.select(F.col("u").alias("w")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Distributed union-find over ``edges(a long, b long)``: returns ``(node, root)``, root the smallest node reachable.

    Alternating large-star and small-star hooking: each round every node hooks its larger
    neighbours, then its smaller ones, onto the least node it sees. Rounds are logarithmic in
    the longest chain; each is one grouped minimum with map-side combining and one join, so no
    node's neighbourhood meets in one place. Self-loops are allowed; nodes without edges do not appear.
    """
    both = edges.select("a", "b").where("a <> b")
    cur = checkpointed(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = cur
    state = [F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))]
    before = cur.agg(*state).first()
    for _ in range(max_rounds):
        sym = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        cur = checkpointed(small)
        after = cur.agg(*state).first()
        if after == before and not cur.join(nodes_of(cur), F.col("v") == F.col("w"), "left_semi").limit(1).count():
            break
        before = after
    else:
        raise RuntimeError("connected_components: no fixed point; raise max_rounds")
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    low_nodes = nodes.select(F.col("v").alias("node")).join(roots, "node", "left_anti").distinct().select("node", F.col("node").alias("root"))
    return roots.unionByName(low_nodes)
