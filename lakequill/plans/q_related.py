"""Related pages by role, over a graph of parts (concepts) and suppliers (sources) that urgent orders link."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.operators import related as R
from lakequill.plans.registry import SQL, query, tbl
from lakequill.sources.tables import discard, stored

# an urgent order links the parts of its first two lines, and the first part with its supplier
GRAPH = """u AS (SELECT l_orderkey AS o, l_partkey AS pk, l_suppkey AS sk, l_returnflag AS rf, l_linestatus AS ls, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'),
h AS (SELECT a.o, 'p' || a.pk AS f, 'p' || b.pk AS g, 's' || a.sk AS s1, 's' || b.sk AS s2, a.rf, a.ls FROM u a LEFT JOIN u b ON a.o = b.o AND b.n = 2 WHERE a.n = 1),
e0 AS (SELECT o, f AS x, g AS y FROM h WHERE f <> g UNION ALL SELECT o, f, s1 FROM h),
und AS (SELECT least(x, y) AS a, greatest(x, y) AS b, CAST(count(*) AS DOUBLE) AS w, list_sort(list(DISTINCT o))[1:8] AS sources FROM e0 GROUP BY ALL),
adj AS (SELECT a, b, w, sources FROM und UNION ALL SELECT b, a, w, sources FROM und), dg AS (SELECT a AS b, count(*) AS deg FROM adj GROUP BY a)"""
NEAR = f"""{GRAPH}, d1 AS (SELECT adj.a AS seed, adj.b AS page, 1 AS dist, w / log2(2 + deg) AS score, adj.a AS pred, sources AS via FROM adj JOIN dg USING (b)),
d2 AS (SELECT x.a AS seed, y.b AS page, 2 AS dist, x.w * y.w * 0.5 / log2(2 + deg) AS score, x.b AS pred, x.w * y.w * 0.5 AS strength, x.sources AS v1, y.sources AS v2 FROM adj x JOIN adj y ON x.b = y.a JOIN dg ON dg.b = y.b
 WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM d1 WHERE d1.seed = x.a AND d1.page = y.b) QUALIFY row_number() OVER (PARTITION BY x.a, y.b ORDER BY x.w * y.w * 0.5 DESC, x.b) = 1),
near AS (SELECT * FROM d1 UNION ALL SELECT seed, page, dist, score, pred, list_concat(v1, list_filter(v2, lambda z: NOT list_contains(v1, z))) FROM d2)"""
CALLED = "co AS (SELECT o AS id, f AS host, g AS page, ls = 'O' AS open FROM h WHERE rf = 'R'), nm AS (SELECT * FROM co WHERE page IS NOT NULL), op AS (SELECT seed, page, bool_or(open) AS open FROM (SELECT host AS seed, page, open FROM nm UNION ALL SELECT page, host, open FROM nm) WHERE seed <> page GROUP BY ALL)"


def _orders(spark, d):
    """A row an urgent order, with its first two lines."""
    urgent = tbl(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("o"))
    line = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    li = tbl(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), *line).join(urgent, "o").select("o", F.struct(*line).alias("x"))
    two = li.groupBy("o").agg(F.slice(F.sort_array(F.collect_list("x")), 1, 2).alias("x"))  # the lines of an order are few
    one, other = F.col("x")[0], F.try_element_at("x", F.lit(2))
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return two.select("o", name("p", one["l_partkey"]).alias("f"), name("p", other["l_partkey"]).alias("g"), name("s", one["l_suppkey"]).alias("s1"), name("s", other["l_suppkey"]).alias("s2"), one["l_returnflag"].alias("rf"), one["l_linestatus"].alias("ls"))


def _links(h):
    e0 = h.where("f <> g").select("o", F.col("f").alias("x"), F.col("g").alias("y")).unionByName(h.select("o", F.col("f").alias("x"), F.col("s1").alias("y")))
    return e0.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _both_ways(und):
    return und.unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b"), *und.columns[2:]))


def _graph(spark, d):
    h = _orders(spark, d)
    return h, _both_ways(_links(h).agg(F.count("*").cast("double").alias("w"), F.slice(F.sort_array(F.collect_set("o")), 1, 8).alias("sources")))


def _callouts(h):
    all_ = h.where("rf = 'R'").select(F.col("o").alias("id"), F.col("f").alias("host"), F.col("g").alias("page"), (F.col("ls") == "O").alias("open"))
    return all_, all_.where("page is not null")


@query("q35_connections", SQL(f"WITH {NEAR} SELECT seed, page, dist, round(score, 6) AS score, pred, via FROM near"))
def connections(spark, d):
    return R.neighbourhood(_graph(spark, d)[1]).withColumn("score", F.round("score", 6))


@query("q34_opponents", SQL(f"""WITH {GRAPH}, {CALLED}, n AS (SELECT DISTINCT 'p' || p_partkey AS seed FROM part), t AS (SELECT host AS seed FROM co UNION SELECT page FROM nm)
SELECT seed, page, CAST(row_number() OVER (PARTITION BY seed ORDER BY open DESC, page) AS INTEGER) AS rank, NULL AS reason FROM op
UNION ALL SELECT seed, NULL, 0, CASE WHEN seed IN (SELECT seed FROM t WHERE seed IS NOT NULL) THEN 'no-opponent' ELSE 'no-callout' END FROM n WHERE seed NOT IN (SELECT seed FROM op)"""))
def opponents(spark, d):
    callouts, named = _callouts(_graph(spark, d)[0])
    seeds = tbl(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("seed")).distinct()
    none = F.lit(None).cast("string")
    found = R.opponents(named).withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("open"), "page"))).select("seed", "page", "rank", none.alias("reason"))
    return found.unionByName(R.opponent_reasons(seeds, callouts, named).select("seed", none.alias("page"), F.lit(0).alias("rank"), "reason"))


TITLES = "ti AS (SELECT 'p' || p_partkey AS page, p_name AS title, p_brand AS c, CASE WHEN p_size <= 2 THEN 'not-on-backbone' WHEN p_size >= 49 THEN 'seed' END AS fixed FROM part UNION ALL SELECT 's' || s_suppkey, s_name, NULL, NULL FROM supplier)"


@query("m5_role_typed_neighbours", SQL(f"""WITH {NEAR}, {CALLED}, {TITLES}, ic AS (SELECT b AS page, sum(w) AS in_count FROM adj GROUP BY b),
lab AS (SELECT c, list(title) AS label FROM (SELECT c, title FROM ti LEFT JOIN ic USING (page) WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY coalesce(in_count, 0) DESC, page) <= 2) GROUP BY c),
sd AS (SELECT page AS seed, title AS s_title, c AS sc, fixed, label FROM ti LEFT JOIN lab USING (c) WHERE c IS NOT NULL),
rel AS (SELECT f AS seed, g AS page, row_number() OVER (PARTITION BY f ORDER BY min(o), g) AS rr FROM h WHERE g IS NOT NULL GROUP BY f, g), src AS (SELECT g AS seed, s2 AS page, row_number() OVER (PARTITION BY g ORDER BY min(o), s2) AS sr FROM h WHERE g IS NOT NULL GROUP BY g, s2),
p1 AS (SELECT seed, page, row_number() OVER (PARTITION BY seed ORDER BY open DESC, page) AS r FROM op JOIN sd USING (seed)),
ev AS (SELECT seed, page FROM near WHERE dist = 1 AND page LIKE 's%' UNION SELECT seed, page FROM src),
p2 AS (SELECT seed, page, row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN length(s_title) >= 4 AND contains(lower(title), lower(s_title)) THEN 0 ELSE 1 END, coalesce(sr, 1000000000), -coalesce(score, 0), page) AS r FROM ev JOIN sd USING (seed) JOIN ti USING (page) LEFT JOIN src USING (seed, page) LEFT JOIN near USING (seed, page)),
n1 AS (SELECT seed, count(*) FILTER (WHERE dist = 1) AS k FROM near WHERE page LIKE 'p%' GROUP BY seed),
p3 AS (SELECT seed, page, row_number() OVER (PARTITION BY seed ORDER BY coalesce(rr, 1000000000), -score, page) AS r FROM near JOIN sd USING (seed) JOIN n1 USING (seed) LEFT JOIN rel USING (seed, page) WHERE page LIKE 'p%' AND (dist = 1 OR k < 2)),
p4 AS (SELECT seed, near.page, dist, ti.title, label, row_number() OVER (PARTITION BY seed ORDER BY dist, -coalesce(in_count, 0), near.page) AS r FROM near JOIN sd USING (seed) JOIN ti ON ti.page = near.page LEFT JOIN ic ON ic.page = near.page WHERE near.page LIKE 'p%' AND ti.c = sc AND sd.fixed IS NULL),
c1 AS (SELECT seed, 'contradiction' AS role, r AS place, page FROM p1 WHERE r <= 2), c2 AS (SELECT seed, 'evidence' AS role, r AS place, page FROM p2 WHERE r <= 2),
t2 AS (SELECT seed, page FROM c1 UNION SELECT seed, page FROM c2), c3 AS (SELECT seed, 'definition' AS role, row_number() OVER (PARTITION BY seed ORDER BY r) AS place, page FROM p3 ANTI JOIN t2 USING (seed, page) QUALIFY place <= 2),
t3 AS (SELECT * FROM t2 UNION SELECT seed, page FROM c3), l4 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY r) AS q FROM p4 ANTI JOIN t3 USING (seed, page)),
dm AS (SELECT seed FROM l4 WHERE q <= 2 GROUP BY seed HAVING count(*) = 2 AND min(dist) = 2 AND list_sort(list_distinct(list(title))) = list_sort(list_distinct(any_value(label)))),
c4 AS (SELECT seed, 'cluster' AS role, CASE WHEN seed IN (SELECT seed FROM dm) THEN q - 2 ELSE q END AS place, page FROM l4 WHERE place BETWEEN 1 AND 2),
ch AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4), tc AS (SELECT host AS seed FROM co UNION SELECT page FROM nm)
SELECT seed, role, CAST(place AS INTEGER) AS place, page, NULL AS reason FROM ch
UNION ALL SELECT seed, role, 0, NULL, CASE role WHEN 'contradiction' THEN CASE WHEN seed IN (SELECT seed FROM tc WHERE seed IS NOT NULL) THEN 'no-opponent' ELSE 'no-callout' END WHEN 'evidence' THEN 'no-source' WHEN 'definition' THEN 'no-concept-neighbor' ELSE coalesce(fixed, 'no-nearby-cluster-peer') END
FROM sd, (VALUES ('contradiction'), ('evidence'), ('definition'), ('cluster')) v(role) WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.seed = sd.seed AND ch.role = v.role)"""))
def role_typed(spark, d):
    """Every part's related pages in four roles, and why a role is empty.

    Of the pages two hops away only those are made that a role asks for: of the part's own cluster, and of parts
    with fewer than two concepts beside them. Orders, links and each role are stored, so that no two steps hold disk together.
    """
    h = stored(_orders(spark, d))
    und, (callouts, named) = stored(_links(h).agg(F.count("*").cast("double").alias("w"))), _callouts(h)
    adj = _both_ways(und)
    near = stored(R.neighbours(adj).where("seed like 'p%'"))
    part, sup = tbl(spark, d, "part"), tbl(spark, d, "supplier")
    fixed = F.when(F.col("p_size") <= 2, "not-on-backbone").when(F.col("p_size") >= 49, "seed")
    parts = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("page"), F.col("p_name").alias("title"), F.col("p_brand").alias("c"), fixed.alias("fixed"))
    title = parts.select("page", "title", "c").unionByName(sup.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("page"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("c")))
    count = adj.groupBy(F.col("b").alias("page")).agg(F.sum("w").alias("in_count"))
    member = parts.join(count, "page", "left").select("c", F.struct(-F.coalesce("in_count", F.lit(0.0)), "page", "title").alias("m"))
    top = member.groupBy("c").agg(F.min("m").alias("m1"))
    second = member.join(top, "c").where("m > m1").groupBy("c").agg(F.min("m").alias("m2"))  # the best two without gathering a cluster
    label = top.join(second, "c", "left").select("c", F.array_compact(F.array("m1.title", "m2.title")).alias("label"))
    called = callouts.select(F.col("host").alias("seed")).unionByName(named.select(F.col("page").alias("seed"))).distinct().withColumn("called", F.lit(True))
    seeds = parts.join(label, "c").select(F.col("page").alias("seed"), "c", "fixed", "label", F.col("title").alias("s_title")).join(called, "seed", "left").withColumn("called", F.coalesce("called", F.lit(False)))
    far = F.lit(10**9)

    def listed(pairs, rank):
        first = pairs.groupBy("seed", "page").agg(F.min("o").alias("o"))
        return first.withColumn(rank, F.row_number().over(W.partitionBy("seed").orderBy("o", "page"))).drop("o")

    related = listed(h.where("g is not null").select(F.col("f").alias("seed"), F.col("g").alias("page"), "o"), "rr")
    sources = listed(h.where("g is not null").select(F.col("g").alias("seed"), F.col("s2").alias("page"), "o"), "sr")
    no_dist, no_title = F.lit(None).cast("int").alias("dist"), F.lit(None).cast("string").alias("title")
    ps = [R.ordered(R.opponents(named).select("seed", "page", "open", no_dist, no_title), "contradiction", [F.desc("open"), "page"])]
    # a source that was cited has a place of its own, so that scores order the pages beside the seed alone
    ev = near.where("page like 's%'").select("seed", "page").unionByName(sources.select("seed", "page")).distinct().join(seeds.select("seed", "s_title"), "seed")
    ev = ev.join(title.drop("c"), "page").join(sources, ["seed", "page"], "left").join(near, ["seed", "page"], "left").select("*", no_dist)
    needle = F.when((F.length("s_title") >= R.NEEDLE) & F.contains(F.lower("title"), F.lower("s_title")), 0).otherwise(1)
    ps.append(R.ordered(ev, "evidence", [needle, F.coalesce("sr", far), -F.coalesce("score", F.lit(0.0)), "page"]).withColumn("title", no_title))
    beside = near.where("page like 'p%'")
    first, second = adj.where("a like 'p%'").select(F.col("a").alias("seed"), F.col("b").alias("mid"), F.col("w").alias("w1")), adj.where("b like 'p%'").select(F.col("a").alias("mid"), F.col("b").alias("page"), "w")
    many = beside.groupBy("seed").agg(F.count("*").alias("k")).where("k >= 2")
    more = R.second_hop(first.join(many, "seed", "left_anti"), second, beside, ["mid"]).join(R.damping(adj), "page").select("seed", "page", (F.col("strength") / F.col("damp")).alias("score"))
    de = beside.unionByName(more).join(related, ["seed", "page"], "left").select("*", no_dist, no_title)
    ps.append(R.ordered(de, "definition", [F.coalesce("rr", far), -F.col("score"), "page"]))
    of = parts.where("c is not null").select("page", "c").distinct()
    same = R.second_hop(first.join(of.withColumnRenamed("page", "seed"), "seed"), second.join(of, "page"), beside, ["mid", "c"]).select("seed", "page", F.lit(2).alias("dist"))
    concepts = beside.select("seed", "page", F.lit(1).alias("dist")).unionByName(same)
    cl = concepts.join(seeds.where("fixed is null").select("seed", F.col("c").alias("sc")), "seed").join(title, "page").where("c = sc").join(count, "page", "left")
    ps.append(R.ordered(cl, "cluster", ["dist", -F.coalesce("in_count", F.lit(0.0)), "page"]))
    ps, row = [stored(p) for p in ps], stored(seeds.select("seed", "label", "fixed", "called"))
    discard(h, und, near)
    return R.assign(row, ps[0].unionByName(ps[1]).unionByName(ps[2]).unionByName(ps[3]))
