"""Graph queries: a small typed page graph, and the order graph of the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.operators import graph as G
from lakequill.plans.fixtures import Derived
from lakequill.plans.registry import SQL, query, tbl

# the parts of an order's first two lines link to each other, by a claim that cites the supplier where the line came back; a part returned has its supplier as a source
LINKS = Derived("links", """SELECT 'P' || x.l_partkey AS src, 'P' || y.l_partkey AS dst, CASE x.l_returnflag WHEN 'R' THEN 'claim-link' WHEN 'A' THEN 'link' ELSE 'fm-related' END AS kind, CASE WHEN x.l_returnflag = 'R' THEN 'S' || x.l_suppkey END AS source, x.l_orderkey AS pos
FROM {lineitem} x JOIN {lineitem} y ON x.l_orderkey = y.l_orderkey WHERE x.l_linenumber = 1 AND y.l_linenumber = 2
UNION ALL SELECT 'P' || l_partkey, 'S' || l_suppkey, 'fm-source', NULL, l_orderkey FROM {lineitem} WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_linestatus = 'F'""")
RANK = "CASE kind WHEN 'claim-link' THEN 5 WHEN 'claim-cite' THEN 4 WHEN 'link' THEN 3 WHEN 'fm-source' THEN 2 ELSE 1 END"
WEIGHT = "CASE kind WHEN 'claim-link' THEN 1.5 WHEN 'claim-cite' THEN 1.0 WHEN 'link' THEN 1.0 WHEN 'fm-source' THEN 0.6 ELSE 0.4 END"
COLLAPSED = f"""{LINKS.cte}, c AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_max(kind, {RANK}) AS kind, count(DISTINCT src < dst) AS ways FROM links WHERE src <> dst GROUP BY 1, 2),
typed AS (SELECT a, b, kind, CAST({WEIGHT} + CASE WHEN ways = 2 AND kind IN ('claim-link', 'link') THEN 0.5 ELSE 0 END AS DOUBLE) AS w FROM c)"""
COCITED = """cb AS (SELECT DISTINCT dst AS via, src AS node FROM links WHERE dst LIKE 'S%'), ck AS (SELECT via, count(*) AS k FROM cb GROUP BY via HAVING count(*) BETWEEN 2 AND 200),
co AS (SELECT x.node AS a, y.node AS b, 1.0 / log2(2 + k) AS w FROM cb x JOIN cb y USING (via) JOIN ck USING (via) WHERE x.node < y.node)"""
FULL = f"""{COLLAPSED}, {COCITED}, g AS (SELECT a, b, sum(w) AS w FROM (SELECT a, b, w FROM typed UNION ALL SELECT * FROM co) GROUP BY ALL), adj AS (SELECT a, b, w FROM g UNION ALL SELECT b, a, w FROM g)"""


def _full(spark, d):
    links = LINKS.frame(spark, d)
    co = G.cocitation(links.where("dst like 'S%'"), "dst", "src")
    return G.collapse(links).select("a", "b", "w").unionByName(co.select("a", "b", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def _seeds(spark, d, n):
    """The n pages of least name, as the pages that a search found first."""
    first = LINKS.frame(spark, d).select(F.col("src").alias("seed")).distinct().orderBy("seed").limit(n)
    pos = F.row_number().over(W.orderBy("seed"))
    return first.select("seed", (1.0 / pos).alias("weight"), (pos - 1).alias("pos"))


@query("d3_edge_kind_collapse", SQL(f"WITH {COLLAPSED} SELECT * FROM typed"))
def collapse(spark, d):
    return G.collapse(LINKS.frame(spark, d))


@query("m1_page_graph", SQL(f"WITH {FULL} SELECT a, b, round(w, 6) AS w FROM g"))
def page_graph(spark, d):
    return _full(spark, d).select("a", "b", F.round("w", 6).alias("w"))


@query("d4_edge_provenance", SQL(f"""WITH {LINKS.cte}, x AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, source, pos FROM links WHERE kind = 'claim-link' AND source IS NOT NULL AND src <> dst),
y AS (SELECT a, b, source, min(pos) AS pos FROM x GROUP BY ALL) SELECT a, b, list(source ORDER BY pos)[1:8] AS sources, count(*) AS n_sources FROM y GROUP BY ALL"""))
def provenance(spark, d):
    x = LINKS.frame(spark, d).where("kind = 'claim-link' and source is not null and src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "source", "pos")
    y = x.groupBy("a", "b", "source").agg(F.min("pos").alias("pos")).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("pos", "source"))).alias("s"), F.count("*").alias("n_sources"))
    return y.select("a", "b", F.slice("s.source", 1, G.SOURCES_CAP).alias("sources"), "n_sources")


@query("m2_seeded_expansion_1hop", SQL(f"""WITH {FULL}, s0 AS (SELECT DISTINCT src FROM links ORDER BY src LIMIT 5), seeds AS (SELECT src AS seed, 1.0 / row_number() OVER (ORDER BY src) AS weight, row_number() OVER (ORDER BY src) - 1 AS pos FROM s0),
dg AS (SELECT a, count(*) AS deg FROM adj GROUP BY a), s AS (SELECT adj.b AS node, seed, pos, weight * adj.w / log2(2 + deg) AS c FROM seeds JOIN adj ON adj.a = seed JOIN dg ON dg.a = adj.b WHERE adj.b NOT IN (SELECT seed FROM seeds)),
t AS (SELECT node, seed, pos, sum(c) AS c FROM s GROUP BY ALL)
SELECT node, round(sum(c), 6) AS score, arg_min(seed, (-round(c, 9), pos)) AS best_seed FROM t GROUP BY node"""))
def expansion(spark, d):
    seeds = _seeds(spark, d, 5)
    return G.expand(G.symmetric(_full(spark, d)), seeds, 1).withColumn("score", F.round("score", 6))


@query("m2_seeded_expansion_2hops", SQL(f"""WITH {FULL}, dg AS (SELECT a, count(*) AS deg FROM adj GROUP BY a),
h1 AS (SELECT adj.b AS node, adj.w AS s, deg FROM adj JOIN dg ON dg.a = adj.b WHERE adj.a = (SELECT min(src) FROM links)),
h2 AS (SELECT adj.b AS node, h1.s * adj.w * 0.5 AS s, dg.deg FROM h1 JOIN adj ON adj.a = h1.node JOIN dg ON dg.a = adj.b WHERE adj.b <> (SELECT min(src) FROM links) AND adj.b NOT IN (SELECT node FROM h1))
SELECT node, round(sum(s / log2(2 + deg)), 6) AS score, (SELECT min(src) FROM links) AS best_seed FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node"""))
def expansion2(spark, d):
    seeds = _seeds(spark, d, 1)
    return G.expand(G.symmetric(_full(spark, d)), seeds, 2).withColumn("score", F.round("score", 6))


@query("m3_edge_explanation", SQL(f"WITH {FULL} SELECT g.a, g.b, coalesce(typed.kind, 'cocite') AS kind, round(g.w, 6) AS w FROM g LEFT JOIN typed USING (a, b)"))
def explanation(spark, d):
    return _full(spark, d).join(G.collapse(LINKS.frame(spark, d)).select("a", "b", "kind"), ["a", "b"], "left").select("a", "b", F.coalesce("kind", F.lit("cocite")).alias("kind"), F.round("w", 6).alias("w"))


@query("m4_two_hop_neighbourhood", SQL(f"""WITH {FULL}, d1 AS (SELECT b AS node FROM adj WHERE a = (SELECT min(src) FROM links)),
d2 AS (SELECT y.b AS node, arg_min(y.a, (-round(x.w * y.w, 9), y.a)) AS mid FROM adj x JOIN adj y ON x.b = y.a WHERE x.a = (SELECT min(src) FROM links) AND y.b <> (SELECT min(src) FROM links) AND y.b NOT IN (SELECT node FROM d1) GROUP BY 1)
SELECT node, 1 AS dist, NULL AS mid FROM d1 UNION ALL SELECT node, 2, mid FROM d2"""))
def two_hops(spark, d):
    adj = G.symmetric(_full(spark, d))
    seed = F.broadcast(_seeds(spark, d, 1).select("seed"))
    d1 = adj.join(seed, F.col("a") == F.col("seed")).select(F.col("b").alias("mid"), F.col("w").alias("w1"))
    d2 = d1.join(adj.withColumnRenamed("a", "mid"), "mid").join(seed, F.col("b") == F.col("seed"), "left_anti").join(d1.select(F.col("mid").alias("b")), "b", "left_anti")
    d2 = d2.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc(F.round(F.col("w1") * F.col("w"), 9)), "mid"))).where("r = 1")
    return d1.select(F.col("mid").alias("node"), F.lit(1).alias("dist"), F.lit(None).cast("string").alias("mid")).unionByName(d2.select(F.col("b").alias("node"), F.lit(2).alias("dist"), "mid"))


# the order graph: orders cite parts; suppliers link to parts
CITE = "bip AS (SELECT DISTINCT l_orderkey AS via, l_partkey AS node FROM lineitem)"


def _cites(spark, d):
    return tbl(spark, d, "lineitem").select(F.col("l_orderkey").alias("via"), F.col("l_partkey").alias("node"))


@query("c3_cocitation", SQL(f"""WITH {CITE}, k AS (SELECT via, count(*) AS k FROM bip GROUP BY via HAVING count(*) BETWEEN 2 AND 200)
SELECT x.node AS a, y.node AS b, round(sum(1.0 / log2(2 + k)), 6) AS w, count(*) AS sources FROM bip x JOIN bip y USING (via) JOIN k USING (via) WHERE x.node < y.node GROUP BY 1, 2"""))
def cocite(spark, d):
    return G.cocitation(_cites(spark, d), "via", "node").withColumn("w", F.round("w", 6))


@query("c5_bipartite_gap", SQL(f"""WITH {CITE}, k AS (SELECT via FROM bip GROUP BY via HAVING count(*) BETWEEN 2 AND 60), near AS (SELECT DISTINCT least(p_partkey, p_size) AS a, greatest(p_partkey, p_size) AS b FROM part)
SELECT x.node AS a, y.node AS b, count(*) AS common FROM bip x JOIN bip y USING (via) JOIN k USING (via) WHERE x.node < y.node AND NOT EXISTS (SELECT 1 FROM near n WHERE n.a = x.node AND n.b = y.node) GROUP BY 1, 2 HAVING count(*) >= 3"""))
def bipartite_gap(spark, d):
    near = tbl(spark, d, "part").select(F.least("p_partkey", "p_size").alias("a"), F.greatest("p_partkey", "p_size").alias("b")).distinct()
    p = G.pairs_through(_cites(spark, d), "via", "node", 2, 60, F.lit(1.0)).groupBy("a", "b").agg(F.count("*").alias("common")).where("common >= 3")
    return p.join(near, ["a", "b"], "left_anti")


# supplier-part edges with counts, by direction
EDGES = "e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*) AS cnt FROM lineitem GROUP BY ALL)"
LABEL = "lab AS (SELECT 's' || s_suppkey AS node, s_nationkey AS c FROM supplier UNION ALL SELECT 'p' || p_partkey, p_size % 25 FROM part)"


def _edges(spark, d):
    return tbl(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.count("*").alias("cnt"))


def _labels(spark, d):
    s = tbl(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("c"))
    return s.unionByName(tbl(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), (F.col("p_size") % 25).alias("c")))


def _und(spark, d):
    return _edges(spark, d).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("cnt").cast("double").alias("w"))


@query("d5_directed_link_counts", SQL(f"WITH {EDGES} SELECT src, dst, cnt AS count FROM e WHERE src <> dst"))
def directed(spark, d):
    return _edges(spark, d).where("src <> dst").withColumnRenamed("cnt", "count")


@query("d6_weighted_degree", SQL(f"WITH {EDGES} SELECT node, CAST(sum(cnt) AS BIGINT) AS in_count FROM (SELECT src AS node, cnt FROM e UNION ALL SELECT dst, cnt FROM e) GROUP BY node"))
def weighted_degree(spark, d):
    return G.symmetric(_und(spark, d)).groupBy(F.col("a").alias("node")).agg(F.sum("w").cast("long").alias("in_count"))


@query("d7_unique_and_instance_degrees", SQL(f"WITH {EDGES} SELECT node, CAST(sum(o) AS BIGINT) AS out_deg, CAST(sum(oc) AS BIGINT) AS out_count, CAST(sum(i) AS BIGINT) AS in_deg, CAST(sum(ic) AS BIGINT) AS in_count FROM (SELECT src AS node, 1 AS o, cnt AS oc, 0 AS i, 0 AS ic FROM e UNION ALL SELECT dst, 0, 0, 1, cnt FROM e) GROUP BY node"))
def degrees(spark, d):
    e = _edges(spark, d)
    z = F.lit(0)
    u = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.col("cnt").alias("oc"), z.alias("i"), z.cast("long").alias("ic")).unionByName(e.select(F.col("dst").alias("node"), z.alias("o"), z.cast("long").alias("oc"), F.lit(1).alias("i"), F.col("cnt").alias("ic")))
    return u.groupBy("node").agg(F.sum("o").alias("out_deg"), F.sum("oc").alias("out_count"), F.sum("i").alias("in_deg"), F.sum("ic").alias("in_count"))


@query("d12_meta_graph", SQL(f"WITH {EDGES}, {LABEL} SELECT x.c AS cs, y.c AS ct, CAST(sum(cnt) AS BIGINT) AS count FROM e JOIN lab x ON x.node = src JOIN lab y ON y.node = dst WHERE x.c <> y.c GROUP BY 1, 2"))
def meta_graph(spark, d):
    lab = _labels(spark, d)
    e = _edges(spark, d).join(lab.withColumnsRenamed({"node": "src", "c": "cs"}), "src").join(lab.withColumnsRenamed({"node": "dst", "c": "ct"}), "dst")
    return e.where("cs <> ct").groupBy("cs", "ct").agg(F.sum("cnt").alias("count"))


MQ = f"""WITH {EDGES}, {LABEL}, j AS (SELECT x.c AS ca, y.c AS cb, CAST(cnt AS DOUBLE) AS w FROM e JOIN lab x ON x.node = src JOIN lab y ON y.node = dst),
t AS (SELECT c, sum(w) AS tot FROM (SELECT ca AS c, w FROM j UNION ALL SELECT cb, w FROM j) GROUP BY c), i AS (SELECT ca AS c, sum(w) AS inn FROM j WHERE ca = cb GROUP BY ca), m AS (SELECT sum(tot) AS m2 FROM t)"""


@query("d29_modularity", SQL(MQ + " SELECT round(sum(2 * coalesce(inn, 0) / m2 - (tot / m2) ** 2), 8) AS q FROM t LEFT JOIN i USING (c), m"))
def modularity(spark, d):
    return G.modularity(_und(spark, d), _labels(spark, d))


@query("c7_cluster_gaps", SQL(MQ + """, n AS (SELECT c, count(*) AS size FROM lab GROUP BY c), x AS (SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, sum(w) AS actual FROM j WHERE ca <> cb GROUP BY 1, 2)
SELECT p.c AS a, q.c AS b, coalesce(actual, 0.0) AS actual, round(p.tot * q.tot / m2, 6) AS expected, round(coalesce(actual, 0.0) / (p.tot * q.tot / m2), 6) AS ratio
FROM t p JOIN t q ON p.c < q.c JOIN m ON true JOIN n np ON np.c = p.c AND np.size >= 5 JOIN n nq ON nq.c = q.c AND nq.size >= 5 LEFT JOIN x ON x.a = p.c AND x.b = q.c WHERE p.tot * q.tot / m2 >= 2"""))
def cluster_gaps(spark, d):
    """Pairs of clusters thinner linked than their strengths suggest; the number of clusters is small by their minimum size."""
    lab = _labels(spark, d)
    la, lb = lab.select(F.col("node").alias("a"), F.col("c").alias("ca")), lab.select(F.col("node").alias("b"), F.col("c").alias("cb"))
    j = _und(spark, d).join(la, "a").join(lb, "b")
    tot = j.select(F.col("ca").alias("c"), "w").unionByName(j.select(F.col("cb").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("tot"))
    tot = tot.join(lab.groupBy("c").agg(F.count("*").alias("size")).where("size >= 5"), "c").drop("size")
    m2 = j.agg((2 * F.sum("w")).alias("m2"))
    x = j.where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("actual"))
    p = tot.select(F.col("c").alias("a"), F.col("tot").alias("ta")).join(tot.select(F.col("c").alias("b"), F.col("tot").alias("tb")), F.col("a") < F.col("b")).crossJoin(F.broadcast(m2))
    p = p.withColumn("e", F.col("ta") * F.col("tb") / F.col("m2")).where("e >= 2").join(x, ["a", "b"], "left")
    actual = F.coalesce("actual", F.lit(0.0))
    return p.select("a", "b", actual.alias("actual"), F.round("e", 6).alias("expected"), F.round(actual / F.col("e"), 6).alias("ratio"))


@query("e11_best_edge_per_cluster_pair", SQL(f"""WITH {EDGES}, {LABEL}, j AS (SELECT src || '>' || dst AS id, src, dst, cnt AS count, least(x.c, y.c) AS ca, greatest(x.c, y.c) AS cb FROM e JOIN lab x ON x.node = src JOIN lab y ON y.node = dst WHERE x.c <> y.c)
SELECT id, src, dst, count, ca, cb FROM j QUALIFY row_number() OVER (PARTITION BY ca, cb ORDER BY count DESC, id) = 1"""))
def skeleton(spark, d):
    e = _edges(spark, d).select(F.concat("src", F.lit(">"), "dst").alias("id"), "src", "dst", F.col("cnt").alias("count"))
    return G.top_edge_per_pair(e, _labels(spark, d)).select("id", "src", "dst", "count", "ca", "cb")


@query("e12_two_strongest_out_edges", SQL(f"""WITH {EDGES}, {LABEL}, j AS (SELECT x.c AS cs, y.c AS ct, CAST(sum(cnt) AS BIGINT) AS count FROM e JOIN lab x ON x.node = src JOIN lab y ON y.node = dst WHERE x.c <> y.c GROUP BY 1, 2)
SELECT cs, ct, count FROM j QUALIFY row_number() OVER (PARTITION BY cs ORDER BY count DESC, ct) <= 2"""))
def strongest(spark, d):
    return meta_graph(spark, d).withColumn("r", F.row_number().over(W.partitionBy("cs").orderBy(F.desc("count"), "ct"))).where("r <= 2").drop("r")


@query("c4_adamic_adar", SQL(f"""WITH n AS (SELECT DISTINCT c_nationkey AS x, c_mktsegment || '/' || (c_custkey % 7) AS y FROM customer), u AS (SELECT CAST(x AS VARCHAR) AS a, y AS b FROM n),
und AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM u), both_ AS (SELECT a AS mid, b AS node FROM und UNION SELECT b, a FROM und), k AS (SELECT mid, count(*) AS k FROM both_ GROUP BY mid HAVING count(*) BETWEEN 2 AND 150)
SELECT p.node AS a, q.node AS b, round(sum(1.0 / log2(k)), 6) AS score FROM both_ p JOIN both_ q USING (mid) JOIN k USING (mid) WHERE p.node < q.node AND NOT EXISTS (SELECT 1 FROM und WHERE und.a = p.node AND und.b = q.node) GROUP BY 1, 2"""))
def adamic(spark, d):
    u = tbl(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("x"), F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey") % 7).alias("y")).distinct()
    und = u.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(1.0).alias("w"))
    return G.adamic_adar(und).withColumn("score", F.round("score", 6))


@query("i4_frontier_score", SQL(f"""WITH {EDGES}, o AS (SELECT src AS node, count(*) AS o FROM e GROUP BY src), i AS (SELECT dst AS node, count(*) AS i FROM e GROUP BY dst), t AS (SELECT 'p' || l_partkey AS node, max(l_shipdate) AS upd FROM lineitem GROUP BY 1 UNION ALL SELECT 's' || l_suppkey, max(l_shipdate) FROM lineitem GROUP BY 1)
SELECT node, round((coalesce(o, 0) - coalesce(i, 0)) * exp(-greatest(0, date_diff('day', CAST(upd AS DATE), DATE '1999-01-01')) / 30.0), 4) AS score FROM t LEFT JOIN o USING (node) LEFT JOIN i USING (node)"""))
def frontier(spark, d):
    li = tbl(spark, d, "lineitem")
    upd = li.groupBy(F.concat(F.lit("p"), "l_partkey").alias("node")).agg(F.max("l_shipdate").alias("upd")).unionByName(li.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("node")).agg(F.max("l_shipdate").alias("upd")))
    e = _edges(spark, d)
    o, i = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o")), e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    days = F.greatest(F.lit(0), F.datediff(F.lit("1999-01-01").cast("date"), F.col("upd").cast("date")))
    return upd.join(o, "node", "left").join(i, "node", "left").select("node", F.round((F.coalesce("o", F.lit(0)) - F.coalesce("i", F.lit(0))) * F.exp(-days / 30.0), 4).alias("score"))


@query("m14_degree_sets", SQL(f"WITH {EDGES} SELECT node, max(o) AS out_deg, max(i) AS in_deg FROM (SELECT src AS node, count(DISTINCT dst) AS o, 0 AS i FROM e WHERE src <> dst GROUP BY 1 UNION ALL SELECT dst, 0, count(DISTINCT src) FROM e WHERE src <> dst GROUP BY 1) GROUP BY node"))
def degree_sets(spark, d):
    e = _edges(spark, d).where("src <> dst").select("src", "dst").distinct()
    z = F.lit(0).cast("long")
    u = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o")).withColumn("i", z).unionByName(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i")).withColumn("o", z))
    return u.groupBy("node").agg(F.max("o").alias("out_deg"), F.max("i").alias("in_deg"))


@query("j4_hub_damping", SQL(f"WITH {EDGES}, dg AS (SELECT dst, count(*) AS deg FROM e GROUP BY dst) SELECT src, round(sum(cnt / log2(2 + deg)), 6) AS damped FROM e JOIN dg USING (dst) GROUP BY src"))
def damping(spark, d):
    e = _edges(spark, d)
    return e.join(e.groupBy("dst").agg(F.count("*").alias("deg")), "dst").groupBy("src").agg(F.round(F.sum(F.col("cnt") / F.log2(2 + F.col("deg"))), 6).alias("damped"))


@query("j7_node_size", SQL(f"WITH {EDGES} SELECT dst AS node, round(2 + 2.2 * log2(1 + sum(cnt)), 6) AS size FROM e GROUP BY dst"))
def node_size(spark, d):
    return _edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.round(2 + 2.2 * F.log2(1 + F.sum("cnt")), 6).alias("size"))


@query("d30_topology_hash", SQL(f"""WITH {FULL}, n AS (SELECT a AS node, sha256(string_agg(b || chr(9) || CAST(CAST(round(w * 1000) AS BIGINT) AS VARCHAR), chr(10) ORDER BY b)) AS h FROM adj GROUP BY a),
k AS (SELECT left(h, 2) AS k, sha256(string_agg(node || chr(9) || h, chr(10) ORDER BY node)) AS h FROM n GROUP BY 1) SELECT k AS slice, h AS topology FROM k"""))
def topology(spark, d):
    """A hash of each node's sorted edges, and of the nodes in each of 256 slices: equal graphs, and no others, have equal rows."""
    adj = G.symmetric(_full(spark, d))
    line = F.concat_ws("\t", "b", F.round(F.col("w") * 1000).cast("long").cast("string"))
    node = adj.groupBy(F.col("a").alias("node")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("h"))
    listed = F.sort_array(F.collect_list(F.struct("node", F.concat_ws("\t", "node", "h").alias("l"))))
    return node.groupBy(F.substring("h", 1, 2).alias("slice")).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["l"]), "\n"), 256).alias("topology"))


@query("b10_backbone_with_reasons", SQL(f"""WITH {EDGES}, n AS (SELECT 'p' || p_partkey AS node, CASE WHEN p_size < 5 THEN 'seed' ELSE 'ok' END AS status FROM part), k AS (SELECT * FROM n WHERE status <> 'seed')
SELECT n.node, CASE WHEN status = 'seed' THEN 'seed' WHEN NOT EXISTS (SELECT 1 FROM e WHERE dst = n.node AND cnt >= 2) THEN 'isolated' END AS reason FROM n"""))
def backbone(spark, d):
    n = tbl(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.when(F.col("p_size") < 5, "seed").otherwise("ok").alias("status"))
    linked = _edges(spark, d).where("cnt >= 2").select(F.col("dst").alias("node")).distinct().withColumn("on", F.lit(True))
    return n.join(linked, "node", "left").select("node", F.when(F.col("status") == "seed", "seed").when(F.col("on").isNull(), "isolated").alias("reason"))


def _bridge_sql() -> str:
    return f"""WITH {EDGES}, {LABEL}, r AS (SELECT dst AS target, src, cnt FROM e)
SELECT target, CAST(sum(cnt) AS BIGINT) AS refs, count(DISTINCT c) AS clusters, round(count(DISTINCT c) * log2(1 + sum(cnt)), 6) AS score FROM r JOIN lab ON lab.node = src GROUP BY target HAVING count(DISTINCT c) >= 2"""


@query("j8_bridge_score", SQL(_bridge_sql()))
def bridges(spark, d):
    r = _edges(spark, d).join(_labels(spark, d).withColumnRenamed("node", "src"), "src")
    return r.groupBy(F.col("dst").alias("target")).agg(F.sum("cnt").alias("refs"), F.countDistinct("c").alias("clusters")).where("clusters >= 2").withColumn("score", F.round(F.col("clusters") * F.log2(1 + F.col("refs")), 6))


@query("c8_neighbour_vote", SQL(f"""WITH {EDGES}, {LABEL}, v AS (SELECT src AS node, c, count(*) AS votes FROM e JOIN lab ON lab.node = dst GROUP BY ALL),
b AS (SELECT node, c FROM v QUALIFY row_number() OVER (PARTITION BY node ORDER BY votes DESC, c) = 1) SELECT s.node, coalesce(CASE WHEN o.c < 10 THEN o.c END, b.c) AS cluster FROM (SELECT DISTINCT src AS node FROM e) s LEFT JOIN lab o USING (node) LEFT JOIN b USING (node)"""))
def vote(spark, d):
    e, lab = _edges(spark, d), _labels(spark, d)
    v = e.join(lab.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.count("*").alias("votes"))
    b = v.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("votes"), "c"))).where("r = 1").select("node", F.col("c").alias("bc"))
    s = e.select(F.col("src").alias("node")).distinct()
    return s.join(lab, "node", "left").join(b, "node", "left").select("node", F.coalesce(F.when(F.col("c") < 10, F.col("c")), "bc").alias("cluster"))


def _cut(spark):
    from lakequill.sources.tables import stored

    return stored


@query("m7_personalized_pagerank", None)
def ppr(spark, d):
    """From the supplier with the least key; thirty rounds."""
    # a row a line, which adds up where the centre reaches it
    lines = tbl(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), F.lit(1.0).alias("w")).where("a is not null and b is not null")
    return G.pagerank_from(G.symmetric(lines), "s0", _cut(spark)).withColumn("r", F.round("r", 8))


@query("m9_louvain", None)
def louvain(spark, d):
    """Communities of the nations' customers and segments, one group per region."""
    n = tbl(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    e = tbl(spark, d, "customer").join(n, "c_nationkey").groupBy("n_regionkey", F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey") % 5).alias("b")).agg(F.count("*").cast("double").alias("w"))
    return G.louvain(e, "n_regionkey")


@query("m9_louvain_two_cliques", SQL("SELECT * FROM (VALUES ('A1', 0), ('A2', 0), ('A3', 0), ('B1', 1), ('B2', 1), ('B3', 1)) v(node, cluster)"))
def cliques(spark, d):
    e = [(0, x + i, x + j, 1.0) for x in "AB" for i, j in (("1", "2"), ("1", "3"), ("2", "3"))] + [(0, "A1", "B1", 1.0)]
    return G.louvain(spark.createDataFrame(e, "g int, a string, b string, w double"), "g").select("node", "cluster")
