"""Further queries: neighbourhoods, visibility, reading order, and small checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.plans.fixtures import Derived
from lakequill.plans.q_graph import EDGES, LABEL, _edges, _labels
from lakequill.plans.registry import SQL, query, tbl


@query("m6_ego_graph", SQL(f"""WITH {EDGES}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), d1 AS (SELECT DISTINCT b AS node FROM u WHERE a = 's1'),
d2 AS (SELECT DISTINCT u.b AS node FROM d1 JOIN u ON u.a = d1.node WHERE u.b <> 's1' AND u.b NOT IN (SELECT node FROM d1)) SELECT 's1' AS node, 0 AS dist UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2"""))
def ego(spark, d):
    e = _edges(spark, d).select("src", "dst")
    u = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    d1 = u.where("src = 's1'").select(F.col("dst").alias("node"))
    d2 = u.join(d1.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().where("node <> 's1'").join(d1, "node", "left_anti")
    return spark.createDataFrame([("s1", 0)], "node string, dist int").unionByName(d1.withColumn("dist", F.lit(1))).unionByName(d2.withColumn("dist", F.lit(2)))


@query("d31_visible_graph_stats", SQL(f"WITH {EDGES}, {LABEL}, v AS (SELECT * FROM lab WHERE c < 10) SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e WHERE src IN (SELECT node FROM v) AND dst IN (SELECT node FROM v)) AS edges, (SELECT count(DISTINCT c) FROM v) AS clusters"))
def visible(spark, d):
    v = _labels(spark, d).where("c < 10")
    shown = _edges(spark, d).join(v.select(F.col("node").alias("src")), "src", "left_semi").join(v.select(F.col("node").alias("dst")), "dst", "left_semi")
    return v.agg(F.count("*").alias("nodes"), F.countDistinct("c").alias("clusters")).crossJoin(shown.agg(F.count("*").alias("edges")))


# an order is a page of blocks: every fourth line goes over the whole width, returned ones stand in the left column
BLOCKS = Derived("blocks", """SELECT l_orderkey AS page, l_linenumber * 100000000 + l_partkey AS id, CASE WHEN l_linenumber % 4 = 1 THEN 0 WHEN l_returnflag = 'R' THEN 5 ELSE 55 END AS x0, l_linenumber * 10 AS y0,
CASE WHEN l_linenumber % 4 = 1 THEN 100 WHEN l_returnflag = 'R' THEN 45 ELSE 95 END AS x1 FROM {lineitem}""")


@query("f12_reading_order", SQL(f"""WITH {BLOCKS.cte}, b AS (SELECT *, x1 - x0 > 60 AS whole FROM blocks), n AS (SELECT *, sum(CASE WHEN whole THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, x0, id ROWS UNBOUNDED PRECEDING) AS band, x0 >= 50 AND NOT whole AS r FROM b)
SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY band, whole DESC, r, y0, x0, id) AS INTEGER) AS pos FROM n"""))
def reading_order(spark, d):
    """Full-width blocks split a page into bands; inside a band the left column comes first. A page's blocks are few."""
    w = W.partitionBy("page").orderBy("y0", "x0", "id")
    b = BLOCKS.frame(spark, d).withColumn("full", F.col("x1") - F.col("x0") > 60).withColumn("band", F.sum(F.col("full").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("right", (F.col("x0") >= 50) & ~F.col("full"))
    return b.select("page", "id", F.row_number().over(W.partitionBy("page").orderBy("band", F.desc("full"), "right", "y0", "x0", "id")).alias("pos"))


@query("q5_length_bounds", SQL("SELECT doc_id, CASE WHEN n > 300 THEN 'long' ELSE 'short' END AS warning FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, CASE WHEN lang = 'de' THEN 30 ELSE 100 END AS least FROM documents) WHERE n > 300 OR n < least"))
def bounds(spark, d):
    """Over 300 lines, or under 100; texts in German stand for books, for which 30 will do."""
    n = tbl(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"), F.when(F.col("lang") == "de", 30).otherwise(100).alias("least")).where("n >= 0")
    return n.where("n > 300 or n < least").select("doc_id", F.when(F.col("n") > 300, "long").otherwise("short").alias("warning"))


FIGS = Derived("figs", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Figure ' || p_size || ' and Figures ' || (p_size + 5) || '-' || (p_size + 7) WHEN 1 THEN 'figure ' || p_size || ', Figure ' || p_size WHEN 2 THEN 'none' WHEN 3 THEN NULL ELSE 'Figures ' || p_size || '-' || (p_size + 90) END AS text FROM {part}")


@query("h38_figure_ids", SQL("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN [p_size, p_size + 5, p_size + 6, p_size + 7] WHEN 1 THEN [p_size] WHEN 2 THEN [] WHEN 3 THEN NULL ELSE [p_size] END AS figures FROM part"))
def figures(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"(?i)figures?\s+(\d+(?:\s*[-–]\s*\d+)?)"), F.lit(1))
    parts = F.transform(found, lambda x: F.transform(F.split(x, r"\s*[-–]\s*"), lambda y: y.cast("int")))
    spans = F.transform(parts, lambda p: F.when(F.abs(F.element_at(p, -1) - F.element_at(p, 1)) <= 20, F.sequence(F.element_at(p, 1), F.element_at(p, -1))).otherwise(F.array(F.element_at(p, 1))))
    return FIGS.frame(spark, d).select("id", F.array_sort(F.array_distinct(F.flatten(spans))).alias("figures"))


@query("q45_stale_pruning", SQL("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"))
def stale(spark, d):
    live = tbl(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tbl(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(live, "l_orderkey", "left_anti")


@query("q23_most_recent", SQL("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"))
def most_recent(spark, d):
    return tbl(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)


@query("q1_basename_index", SQL("SELECT lower(regexp_extract(url, '([^/]*)$', 1)) AS key, list(page_id ORDER BY page_id) AS pages FROM pages GROUP BY 1"))
def basenames(spark, d):
    return tbl(spark, d, "pages").groupBy(F.lower(F.regexp_extract("url", "([^/]*)$", 1)).alias("key")).agg(F.sort_array(F.collect_list("page_id")).alias("pages"))


@query("q2_duplicate_owners", SQL("SELECT l_orderkey, l_linenumber, count(*) AS owners, list_sort(list(DISTINCT l_partkey))[1:3] AS shown FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"))
def owners(spark, d):
    g = tbl(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("owners"), F.sort_array(F.collect_set("l_partkey")).alias("s"))
    return g.where("owners > 1").select("l_orderkey", "l_linenumber", "owners", F.slice("s", 1, 3).alias("shown"))
