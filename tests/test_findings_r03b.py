"""Steps whose work grew faster than their input: what is read or searched again."""

from pyspark.sql import functions as F

from lakequill.operators import claims as C
from lakequill.operators import graph as G
from lakequill.operators import spelt as S


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_expansion_reads_the_graph_once(spark):
    adj = G.symmetric(spark.range(1, 30).select(F.lit("n0").alias("a"), F.concat(F.lit("n"), F.col("id") % 10).alias("b"), F.lit(1.0).alias("w")).distinct().where("a <> b"))
    seeds = spark.createDataFrame([("n1", 1.0, 0)], "seed string, weight double, pos int")
    out = G.expand(adj, seeds, 2)
    assert "Range (" not in _plan(out)
    assert {r.node for r in out.collect()} == {"n0", *(f"n{i}" for i in range(2, 10))}


def test_callouts_are_joined_once(spark):
    callouts = spark.range(1, 4).select("id", F.concat(F.lit("p"), "id").alias("host"))
    said = [(1, "p2", False), (2, "p1", False), (1, "p3", False), (3, "s9", True), (2, "p3", False), (2, "s9", True)]
    parties = spark.createDataFrame([(f"p{i}", "concept") for i in range(1, 4)], "party string, party_type string")
    out = C.one_sided(callouts, spark.createDataFrame(said, "id long, name string, is_source boolean"), parties)
    assert "Range (" not in _plan(out)
    # p2 names p1 in return, and p3 a page that p1's callout names; p3 shares a source with p2 alone
    assert sorted((r.host, r.party) for r in out.collect()) == [("p1", "p3")]


def test_spelt_numbers_are_searched_once(spark):
    out = spark.range(1).select(F.lit("x twenty one  Thousand, one hundred million; half").alias("t")).select(S.spelt_keys("t").alias("k"))
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(S.spelt_keys("t").alias("k"))
    assert _plan(plan).count("regexp_extract_all") == 1
    assert sorted(out.first().k) == sorted(["21", "21000", "100", "100000000", "0.5"])
