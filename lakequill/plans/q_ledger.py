"""Ledger, quality and survey queries over orders, customers, events, documents and labels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.operators import ledger as L
from lakequill.plans.registry import SQL, query, tbl


@query("d8_status_type_matrix", SQL("SELECT o_orderpriority AS type, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1"))
def matrix(spark, d):
    p = tbl(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("type")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.na.fill(0)


@query("d9_health_summary", SQL("SELECT count(*) AS customers, count(*) FILTER (n = 0) AS orphans, CAST(sum(n) AS BIGINT) AS edges FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"))
def health(spark, d):
    n = tbl(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return tbl(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").agg(F.count("*").alias("customers"), F.count_if(F.col("n").isNull()).alias("orphans"), F.sum(F.coalesce("n", F.lit(0))).alias("edges"))


@query("d10_cluster_summary", SQL("WITH r AS (SELECT c_nationkey AS c, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer) SELECT c AS cluster, max(size) AS size, list(c_custkey ORDER BY r) FILTER (r <= 5) AS top FROM r GROUP BY c"))
def clusters(spark, d):
    c = tbl(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), "c_custkey", "c_acctbal")
    top = c.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("r <= 5")
    top = top.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "c_custkey"))), lambda x: x["c_custkey"]).alias("top"))
    return c.groupBy("cluster").agg(F.count("*").alias("size")).join(top, "cluster").select("cluster", "size", "top")


@query("d18_idf_table", SQL("WITH n AS (SELECT count(*) AS n FROM orders), f AS (SELECT l_partkey AS feature, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY 1) SELECT feature, df, round(ln(1 + n / df), 6) AS idf FROM f, n"))
def idf(spark, d):
    n = tbl(spark, d, "orders").agg(F.count("*").alias("n"))
    f = tbl(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.countDistinct("l_orderkey").alias("df"))
    return f.crossJoin(F.broadcast(n)).select("feature", "df", F.round(F.log(1 + F.col("n") / F.col("df")), 6).alias("idf"))


@query("d19_profile_share", SQL("WITH m AS (SELECT c_mktsegment AS survey, count(*) AS members FROM customer GROUP BY 1) SELECT c_mktsegment AS survey, c_nationkey AS feature, round(count(*) * 1.0 / members, 6) AS share FROM customer JOIN m ON survey = c_mktsegment GROUP BY 1, 2, members"))
def profile(spark, d):
    c = tbl(spark, d, "customer").select(F.col("c_mktsegment").alias("survey"), F.col("c_nationkey").alias("feature"))
    m = c.groupBy("survey").agg(F.count("*").alias("members"))
    return c.groupBy("survey", "feature").agg(F.count("*").alias("n")).join(m, "survey").select("survey", "feature", F.round(F.col("n") / F.col("members"), 6).alias("share"))


@query("d21_survey_stats", SQL("SELECT o_orderpriority AS survey, min(n) AS least, median(n) AS middle, max(n) AS most FROM (SELECT o_orderpriority, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1"))
def stats(spark, d):
    n = tbl(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return tbl(spark, d, "orders").join(n, "o_orderkey").groupBy(F.col("o_orderpriority").alias("survey")).agg(F.min("n").alias("least"), F.percentile("n", 0.5).alias("middle"), F.max("n").alias("most"))


@query("d22_role_counts", SQL("SELECT conv_id % 10 AS ident, role, count(*) AS n FROM conversations GROUP BY ALL"))
def roles(spark, d):
    return tbl(spark, d, "conversations").groupBy((F.col("conv_id") % 10).alias("ident"), "role").agg(F.count("*").alias("n"))


@query("d23_stamp_suppression", SQL("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS kept FROM n WHERE n < 3 GROUP BY doc_id"))
def stamps(spark, d):
    """A line that stands three times or more in a document is a stamp and counts no more."""
    l = tbl(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''").groupBy("doc_id", "line").agg(F.count("*").alias("n"))  # noqa: E741
    return l.where("n < 3").groupBy("doc_id").agg(F.sum("n").alias("kept"))


@query("d24_verdict_summary", SQL("SELECT toxic AS verdict, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS rate FROM labels GROUP BY toxic"))
def verdicts(spark, d):
    v = tbl(spark, d, "labels").groupBy(F.col("toxic").alias("verdict")).agg(F.count("*").alias("n"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("n").alias("t")))).select("verdict", "n", F.round(F.col("n") / F.col("t"), 6).alias("rate"))


@query("d25_state_counts_with_zeros", SQL("SELECT s AS state, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s"))
def states(spark, d):
    n = tbl(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(s,) for s in "FOPX"], "state string").join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@query("d26_population_by_year", SQL("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1"))
def by_year(spark, d):
    return tbl(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("b19_text_quality", SQL("SELECT doc_id, CASE WHEN length(text) < 50 THEN 'none' WHEN length(text) < 500 THEN 'sparse' WHEN (length(text) - length(replace(text, chr(65533), ''))) * 500 >= length(text) THEN 'glyph-loss' ELSE 'ok' END AS quality FROM documents"))
def quality(spark, d):
    n, lost = F.length("text"), F.length("text") - F.length(F.regexp_replace("text", "[�-]", ""))
    return tbl(spark, d, "documents").select("doc_id", F.when(n < 50, "none").when(n < 500, "sparse").when(lost * 500 >= n, "glyph-loss").otherwise("ok").alias("quality"))


@query("b18_table_dump_filter", SQL(r"WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents) SELECT doc_id, len(ws) < 6 OR len(list_filter(ws, lambda w: regexp_matches(w, '[0-9]'))) > 0.35 * len(ws) AS dump FROM t"))
def dumps(spark, d):
    t = tbl(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)).alias("ws"))
    return t.select("doc_id", ((F.size("ws") < 6) | (F.size(F.filter("ws", lambda w: w.rlike("[0-9]"))) > 0.35 * F.size("ws"))).alias("dump"))


@query("b14_ready_candidates", SQL("SELECT l_partkey AS key, count(DISTINCT l_orderkey) AS documents FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2"))
def ready(spark, d):
    return tbl(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("key")).agg(F.countDistinct("l_orderkey").alias("documents")).where("documents >= 2")


@query("b15_ready_references", SQL("SELECT l_partkey AS key, count(*) AS demand FROM lineitem WHERE l_returnflag = 'N' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1 HAVING count(*) >= 2"))
def ready_refs(spark, d):
    done = tbl(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("key"))
    return tbl(spark, d, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("demand")).where("demand >= 2").join(done, "key", "left_anti")


@query("b16_compile_debt", SQL("WITH c AS (SELECT l_partkey AS page, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 30) AS inbox, count(*) FILTER (l_returnflag = 'N') AS waiting, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS topics FROM lineitem GROUP BY 1) SELECT page, inbox, waiting, topics FROM c WHERE inbox >= 5 OR (topics = 0 AND waiting >= 15)"))
def debt(spark, d):
    c = tbl(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("page")).agg(
        F.count_if((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 30)).alias("inbox"),
        F.count_if(F.col("l_returnflag") == "N").alias("waiting"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).alias("topics"),
    )
    return c.where("inbox >= 5 or (topics = 0 and waiting >= 15)")


@query("c19_reverse_index", SQL("SELECT l_partkey AS feature, list_sort(list(DISTINCT l_suppkey)) AS sources FROM lineitem GROUP BY 1"))
def reverse(spark, d):
    return tbl(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("sources"))


@query("c20_cutoff_theta_join", SQL("WITH s AS (SELECT o_custkey AS survey, min(o_orderdate) AS cutoff FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT survey, o_orderkey AS source FROM s JOIN orders ON o_custkey = survey AND o_orderdate > cutoff WHERE o_orderpriority <> '1-URGENT'"))
def cutoff(spark, d):
    o = tbl(spark, d, "orders")
    s = o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("cutoff"))
    return o.where("o_orderpriority <> '1-URGENT'").join(s, "o_custkey").where("o_orderdate > cutoff").select(F.col("o_custkey").alias("survey"), F.col("o_orderkey").alias("source"))


@query("c21_as_of_last_date", SQL("SELECT o.o_orderkey, max(e.o_orderdate) AS last_date FROM orders o LEFT JOIN orders e ON e.o_custkey = o.o_custkey AND e.o_orderpriority = '1-URGENT' AND e.o_orderdate < o.o_orderdate GROUP BY 1"))
def as_of(spark, d):
    """As-of by one ordered pass: the running maximum of the marked rows before each row, instead of a range join."""
    w = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").cast("timestamp").cast("long")).rangeBetween(W.unboundedPreceding, -1)
    return tbl(spark, d, "orders").select("o_orderkey", F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).over(w).alias("last_date"))


@query("c25_full_outer_difference", SQL("WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0) SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)"))
def difference(spark, d):
    return L.missing_both_ways(tbl(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k")), tbl(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), "k")


@query("o2_referential_integrity", SQL("SELECT DISTINCT sale_id AS k, 'left' AS side FROM sale_lines l WHERE NOT EXISTS (SELECT 1 FROM sales s WHERE s.sale_id = l.sale_id) UNION ALL SELECT DISTINCT sale_id, 'right' FROM sales s WHERE NOT EXISTS (SELECT 1 FROM sale_lines l WHERE l.sale_id = s.sale_id)"))
def integrity(spark, d):
    """Lines of sales that there are not, and sales without a line."""
    of = lambda t, left: tbl(spark, d, t).select(F.col("sale_id").alias("k"), F.lit(left).alias("left"))
    # one aggregate over both sides, so that nothing is broadcast and keys are summed up before the shuffle; a missing key meets none
    both = of("sale_lines", True).unionByName(of("sales", False)).groupBy("k").agg(F.max("left").alias("l"), F.max(~F.col("left")).alias("r"))
    alone = F.col("k").isNull() | ~(F.col("l") & F.col("r"))
    return both.where(alone).select("k", F.explode(F.array_compact(F.array(F.when(F.col("l"), "left"), F.when(F.col("r"), "right")))).alias("side"))


@query("o3_key_uniqueness", SQL("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"))
def uniqueness(spark, d):
    return tbl(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


@query("o5_verification_bundle", SQL("""SELECT 'empty-balance' AS check, 'WARN' AS severity, CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no-orders', 'FAIL', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'bad-key', 'FAIL', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""))
def bundle(spark, d):
    c, o = tbl(spark, d, "customer"), tbl(spark, d, "orders")
    a = L.finding(c.where("c_acctbal < 0"), "empty-balance", "WARN", F.col("c_custkey"))
    b = L.finding(c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti"), "no-orders", "FAIL", F.col("c_custkey"))
    return a.unionByName(b).unionByName(L.finding(o.join(c, c["c_custkey"] == o["o_custkey"], "left_anti"), "bad-key", "FAIL", F.col("o_orderkey")))


@query("o9_candidate_upsert", SQL("WITH old AS (SELECT user_id, min(ts) AS f, max(ts) AS l, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), new AS (SELECT user_id, min(ts) AS f, max(ts) AS l, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type = 'purchase' GROUP BY 1) SELECT coalesce(o.user_id, n.user_id) AS user_id, least(o.f, n.f) AS first_seen, greatest(o.l, n.l) AS last_seen, coalesce(o.n, n.n) AS mentions FROM old o FULL JOIN new n ON o.user_id = n.user_id"))
def candidates(spark, d):
    e = tbl(spark, d, "events")
    agg = [F.min("ts").alias("f"), F.max("ts").alias("l"), F.count("*").alias("n")]
    old = e.where("ts < timestamp'2024-01-15'").groupBy("user_id").agg(*agg)
    new = e.where("ts >= timestamp'2024-01-10' and event_type = 'purchase'").groupBy("user_id").agg(*agg)
    first, last = F.least("old.f", "new.f"), F.greatest("old.l", "new.l")
    return L.upsert(old, new, "user_id", {"first_seen": (first, F.col("new.f")), "last_seen": (last, F.col("new.l")), "mentions": (F.col("old.n"), F.col("new.n"))})


@query("o11_queue_refresh", SQL("WITH q AS (SELECT o_custkey AS page, CASE min(o_orderstatus) WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'skipped' END AS state FROM orders GROUP BY 1), debt AS (SELECT c_custkey AS page FROM customer WHERE c_acctbal > 5000) SELECT coalesce(q.page, debt.page) AS page, CASE WHEN state IS NULL AND debt.page IS NOT NULL THEN 'pending' WHEN state = 'done' AND debt.page IS NOT NULL THEN 'pending' WHEN state IN ('pending', 'in_progress') AND debt.page IS NULL THEN 'done' ELSE state END AS state FROM q FULL JOIN debt ON q.page = debt.page"))
def refresh(spark, d):
    s = F.min("o_orderstatus")
    q = tbl(spark, d, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.when(s == "F", "done").when(s == "O", "pending").otherwise("skipped").alias("state"))
    debt_ = tbl(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("page"), F.lit(True).alias("debt"))
    return q.join(debt_, "page", "full_outer").select("page", L.refresh_state(F.col("state"), F.coalesce("debt", F.lit(False))).alias("state"))


@query("o12_block_after_three", SQL("WITH v AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 'rejected' ELSE event_type END AS verdict FROM events) SELECT user_id, CASE WHEN count(*) FILTER (verdict = 'rejected') >= 3 THEN 'blocked' ELSE arg_max(verdict, (ts, event_id)) END AS state, count(*) FILTER (verdict = 'rejected') AS rejections FROM v GROUP BY 1"))
def block(spark, d):
    v = tbl(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", "rejected").otherwise(F.col("event_type")).alias("verdict"))
    return L.blocked_after(v, "user_id", ["ts", "event_id"], "verdict")


@query("o13_idempotent_append", SQL("WITH a AS (SELECT DISTINCT lower(trim(text)) AS t FROM benchmark) SELECT doc_id FROM documents WHERE lower(trim(text)) NOT IN (SELECT t FROM a)"))
def append(spark, d):
    have = tbl(spark, d, "benchmark").select(F.lower(F.trim("text")).alias("t")).distinct()
    return tbl(spark, d, "documents").select("doc_id", F.lower(F.trim("text")).alias("t")).join(have, "t", "left_anti").select("doc_id")


@query("o7_claim_sampling", SQL("SELECT lang, count(*) AS n FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id) AS r, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE r <= 20 GROUP BY lang"))
def sampling(spark, d):
    left = tbl(spark, d, "documents").select("lang", "doc_id").join(tbl(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    w = W.partitionBy("lang").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), "doc_id")
    return left.withColumn("r", F.row_number().over(w)).where("r <= 20").groupBy("lang").agg(F.count("*").alias("n"))


@query("o17_cluster_assignment", SQL("SELECT coalesce(CAST(s_nationkey AS VARCHAR), 'unassigned') AS cluster, count(*) AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem) l LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s_suppkey = l_suppkey GROUP BY 1"))
def assignment(spark, d):
    s = tbl(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return tbl(spark, d, "lineitem").select("l_suppkey").distinct().join(s, "l_suppkey", "left").groupBy(F.coalesce(F.col("s_nationkey").cast("string"), F.lit("unassigned")).alias("cluster")).agg(F.count("*").alias("n"))


@query("f4_queue_order", SQL("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS INTEGER) AS pos FROM orders QUALIFY pos <= 50"))
def queue(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    order = ["s", F.desc("o_totalprice"), "o_orderkey"]
    top = tbl(spark, d, "orders").select("o_orderkey", "o_totalprice", s.alias("s")).orderBy(*order).limit(50)
    return top.withColumn("pos", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))).select("o_orderkey", "pos")


@query("f8_reverse_topk", SQL("SELECT l_partkey, l_suppkey, q FROM (SELECT l_partkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 2"))
def reverse_topk(spark, d):
    q = tbl(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return q.withColumn("r", F.row_number().over(W.partitionBy("l_partkey").orderBy(F.desc("q"), "l_suppkey"))).where("r <= 2").drop("r")


@query("f10_hot_window_prefix", SQL("WITH c AS (SELECT conv_id, turn, length(text) // 3 AS cost, sum(length(text) // 3) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id, turn, cost FROM c WHERE upto <= 2000 AND r <= 5"))
def hot_window(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = tbl(spark, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 3).alias("cost"))
    return c.withColumn("upto", F.sum("cost").over(w)).withColumn("r", F.row_number().over(w)).where("upto <= 2000 and r <= 5").select("conv_id", "turn", "cost")


@query("f9_budgeted_greedy", None)
def greedy(spark, d):
    """Later smaller items may still fit, so the fold is sequential inside each (bounded) conversation."""

    def take(pdf):
        left, out = 500, []
        for n in pdf.sort_values("turn").cost:
            ok = n <= left
            left -= n if ok else 0
            out.append(ok)
        return pdf.sort_values("turn").assign(taken=out)

    c = tbl(spark, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 3).alias("cost"))
    return c.groupBy("conv_id").applyInPandas(take, "conv_id long, turn long, cost long, taken boolean")


@query("g3_set_difference", SQL("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 EXCEPT SELECT p_partkey FROM part WHERE p_size > 10"))
def set_difference(spark, d):
    cited = tbl(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return cited.subtract(tbl(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("k")))


@query("g4_token_intersection", SQL("WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS bs FROM benchmark), p AS (SELECT i.item_id, j.item_id AS other, len(list_intersect(i.bs, j.bs)) AS n FROM b i JOIN b j ON i.item_id < j.item_id) SELECT item_id, other, n FROM p WHERE n >= 5"))
def intersection(spark, d):
    """By shared tokens, not by pairs: only items with a token in common meet."""
    b = tbl(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("w"))
    return b.join(b.select(F.col("item_id").alias("other"), "w"), "w").where("item_id < other").groupBy("item_id", "other").agg(F.count("*").alias("n")).where("n >= 5")


@query("q13_numbering_continuity", SQL("SELECT l_orderkey, max(l_linenumber) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AS continuous, count(*) > count(DISTINCT l_linenumber) AS repeated FROM lineitem GROUP BY 1"))
def numbering(spark, d):
    n = F.countDistinct("l_linenumber")
    return tbl(spark, d, "lineitem").groupBy("l_orderkey").agg(((F.max("l_linenumber") == n) & (F.min("l_linenumber") == 1)).alias("continuous"), (F.count("*") > n).alias("repeated"))


@query("q15_hub_scan", SQL("SELECT source AS page, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents GROUP BY source HAVING sum(strlen(text)) >= 50000 OR sum(length(text) - length(replace(text, chr(10), '')) + 1) >= 250"))
def hubs(spark, d):
    """A source's documents make up one page; large pages are hubs."""
    t = tbl(spark, d, "documents").select(F.col("source").alias("page"), F.octet_length("text").cast("long").alias("b"), F.size(F.split("text", "\n", -1)).cast("long").alias("l")).where("b is not null")
    return t.groupBy("page").agg(F.sum("b").alias("bytes"), F.sum("l").alias("lines")).where("bytes >= 50000 or lines >= 250")


@query("q17_registry_reconciliation", SQL("SELECT count(*) FILTER (l.doc_id IS NULL) AS unregistered, count(*) FILTER (d.doc_id IS NULL) AS missing, count(*) AS total FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id"))
def reconciliation(spark, d):
    j = tbl(spark, d, "documents").select("doc_id", F.lit(1).alias("d")).join(tbl(spark, d, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("l").isNull()).alias("unregistered"), F.count_if(F.col("d").isNull()).alias("missing"), F.count("*").alias("total"))


@query("q22_island_marking", SQL("WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity > 45 AS mark, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS g FROM lineitem) SELECT l_orderkey, l_linenumber, bool_or(mark) OVER (PARTITION BY l_orderkey, l_returnflag, g) AS marked FROM l"))
def islands(spark, d):
    l = tbl(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") > 45).alias("mark"), (F.col("l_linenumber") - F.row_number().over(W.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))).alias("g"))  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", F.bool_or("mark").over(W.partitionBy("l_orderkey", "l_returnflag", "g")).alias("marked"))


@query("q33_retracted_and_cites_all", SQL("SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3"))
def cites_all(spark, d):
    return tbl(spark, d, "lineitem").where("l_returnflag in ('A', 'N', 'R')").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n")).where("n = 3").select("l_orderkey")


@query("q42_path_category", SQL("SELECT page_id, CASE WHEN url LIKE '%.pdf' THEN 'pdf' WHEN contains(url, '/blog') THEN 'blog' WHEN contains(url, '/a') THEN 'a' ELSE 'other' END AS category FROM pages"))
def category(spark, d):
    u = F.col("url")
    return tbl(spark, d, "pages").select("page_id", F.when(u.endswith(".pdf"), "pdf").when(u.contains("/blog"), "blog").when(u.contains("/a"), "a").otherwise("other").alias("category"))


@query("l5_map_merge", SQL("""WITH n AS (SELECT client_id, segment, city, balance FROM client_changes WHERE op <> 'D' QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) = 1),
m AS (SELECT c.client_id, unnest(['name', 'city', 'segment', 'balance']) AS k, unnest([c.name, coalesce(n.city, c.city), coalesce(n.segment, c.segment), CAST(CAST(round(n.balance * 100) AS BIGINT) AS VARCHAR)]) AS v FROM clients c JOIN n USING (client_id)) SELECT client_id, k, v FROM m WHERE v IS NOT NULL"""))
def map_merge(spark, d):
    """What a client's last change gives goes over what was there; other fields stay."""
    pair = lambda k, c: F.struct(F.lit(k).alias("k"), c.alias("v"))
    fields = lambda *ps: F.map_from_entries(F.filter(F.array(*ps), lambda p: p["v"].isNotNull()))
    change = tbl(spark, d, "client_changes").where("op <> 'D'").groupBy("client_id").agg(F.max_by(F.struct("segment", "city", "balance"), F.struct("seq", "change_id")).alias("n"))
    both = tbl(spark, d, "clients").join(change, "client_id").select(
        "client_id",
        fields(pair("name", F.col("name")), pair("city", F.col("city")), pair("segment", F.col("segment"))).alias("old"),
        fields(pair("city", F.col("n.city")), pair("segment", F.col("n.segment")), pair("balance", F.round(F.col("n.balance") * 100).cast("long").cast("string"))).alias("new"),
    )
    kept = F.map_filter("old", lambda k, v: ~F.map_contains_key("new", k))
    return both.select("client_id", F.explode(F.map_concat(kept, "new")).alias("k", "v"))


@query("l1_json_tolerant", SQL("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"))
def tolerant(spark, d):
    return tbl(spark, d, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"}).getField("k").alias("k"))


@query("k1_ordered_distinct", SQL("SELECT l_orderkey, list(f ORDER BY p, f) AS flags FROM (SELECT l_orderkey, l_returnflag AS f, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1"))
def ordered_distinct(spark, d):
    s = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return tbl(spark, d, "lineitem").groupBy("l_orderkey").agg(s.alias("s")).select("l_orderkey", F.array_distinct(F.transform("s", lambda x: x["l_returnflag"])).alias("flags"))
