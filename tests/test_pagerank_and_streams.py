import numpy as np
from pyspark.sql import functions as F

from lakequill.operators import graph as G
from lakequill.operators import sessions as S
from lakequill.sources.tables import checkpointed
from lakequill.streaming import events as E

DIR = "/root/testdata/sf0.001"


def test_pagerank_is_the_matrix_iteration(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0)]
    und = spark.createDataFrame(edges, "a string, b string, w double")
    got = {r["node"]: r["r"] for r in G.pagerank_from(G.symmetric(und), "a", checkpointed, rounds=10).collect()}
    m = np.zeros((4, 4))
    for x, y, w in edges:
        m["abcd".index(x), "abcd".index(y)] = m["abcd".index(y), "abcd".index(x)] = w
    p, r = m / m.sum(1, keepdims=True), np.eye(4)[0]
    for _ in range(10):
        r = 0.85 * r @ p + 0.15 * np.eye(4)[0]
    assert all(abs(got[n] - r[i]) < 1e-9 for i, n in enumerate("abcd"))


def test_stream_sessions_equal_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{DIR}/events.parquet")
    out = []
    E.run_once(E.inactivity_sessions(E.read(spark, f"{DIR}/events*.parquet", batch.schema)), lambda df, _: out.extend(df.collect()), str(tmp_path / "a"), "append")
    per_user = {r["user_id"]: r["gaps"] + 1 for r in S.gaps(batch, "user_id", "ts", "event_id").collect()}
    seen: dict[int, int] = {}
    for r in out:
        seen[r["user_id"]] = seen.get(r["user_id"], 0) + 1
    # sessions within the watermark of the end stay open
    assert sum(seen.values()) > 0.9 * sum(per_user.values()) and all(n <= per_user[u] for u, n in seen.items())


def test_stream_state_machine(spark, tmp_path):
    batch = spark.read.parquet(f"{DIR}/events.parquet")
    out = {}
    E.run_once(E.rejections(E.read(spark, f"{DIR}/events*.parquet", batch.schema)), lambda df, _: out.update({r["user_id"]: (r["rejections"], r["state"]) for r in df.collect()}), str(tmp_path / "b"), "update")
    want = {r["user_id"]: r["n"] for r in batch.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n")).collect()}
    assert out == {u: (n, "blocked" if n >= 3 else "open") for u, n in want.items()}
