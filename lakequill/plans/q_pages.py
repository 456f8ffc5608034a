"""Normalisation, visibility, ledger merges, freshness and catalogue queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.functions import text as TX
from lakequill.plans.q_graph import LINKS
from lakequill.plans.registry import SQL, query, tbl

# The types that count as such, the default type of a folder, and the words by which a state is guessed.
TYPES = ["building", "machinery", "furniture"]
FOLDERS = {0: "concept", 1: "entity", 2: "source", 3: "question", 4: "note"}
OPEN_HINTS, EXPLAINED_HINTS = ["the of", "ouwh"], ["end", "rend"]


@query("b4_type_by_folder", SQL(f"SELECT c_custkey AS page, CASE WHEN lower(c_mktsegment) IN ({', '.join(map(repr, TYPES))}) THEN lower(c_mktsegment) ELSE CASE c_nationkey % 5 {' '.join(f'WHEN {k} THEN {v!r}' for k, v in FOLDERS.items())} END END AS type FROM customer"))
def type_by_folder(spark, d):
    folder = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])[F.col("c_nationkey") % 5]
    kind = F.lower("c_mktsegment")
    return tbl(spark, d, "customer").select(F.col("c_custkey").alias("page"), F.when(kind.isin(TYPES), kind).otherwise(folder).alias("type"))


@query("b5_status_or_unknown", SQL("SELECT o_orderkey AS page, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'unknown' END AS status FROM orders"))
def status(spark, d):
    s = F.col("o_orderstatus")
    return tbl(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.when(s.isin("F", "O"), s).otherwise("unknown").alias("status"))


@query("b8_type_visibility", SQL("""WITH o AS (SELECT * FROM (VALUES (FALSE), (TRUE)) v(all_types)), s AS (SELECT p_partkey AS k, p_brand IN (SELECT min(p_brand) FROM part UNION ALL SELECT max(p_brand) FROM part) AS shown FROM part)
SELECT all_types, l_partkey AS src, l_suppkey AS dst, count(*) AS cnt FROM lineitem JOIN s ON s.k = l_partkey JOIN supplier ON s_suppkey = l_suppkey, o WHERE all_types OR (shown AND s_nationkey < 12) GROUP BY ALL"""))
def visible(spark, d):
    """With a set of visible types an edge is hidden if either end is; without a set (``all_types``) nothing is."""
    part = tbl(spark, d, "part")
    ends = part.agg(F.min("p_brand").alias("lo"), F.max("p_brand").alias("hi"))
    src = part.crossJoin(F.broadcast(ends)).select(F.col("p_partkey").alias("src"), F.col("p_brand").isin(F.col("lo"), F.col("hi")).alias("s_on"))
    dst = tbl(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), (F.col("s_nationkey") < 12).alias("d_on"))
    edges = tbl(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("cnt"))
    both = edges.join(src, "src").join(dst, "dst").withColumn("all_types", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.where("all_types or (s_on and d_on)").select("all_types", "src", "dst", "cnt")


@query("b9_all_terms_filter", SQL("SELECT doc_id FROM documents WHERE contains(lower(text || ' ' || source), 'the') AND contains(lower(text || ' ' || source), 'end') AND contains(lower(text || ' ' || source), 'ing')"))
def all_terms(spark, d):
    body = F.lower(F.concat_ws(" ", "text", "source"))
    terms = F.array(*map(F.lit, ["THE".casefold(), "end", "ing"]))
    return tbl(spark, d, "documents").withColumn("body", body).where(F.forall(terms, lambda t: F.col("body").contains(t))).select("doc_id")


@query("b11_screen_backbone", SQL(f"""WITH {LINKS.cte}, e AS (SELECT DISTINCT CAST(substr(src, 2) AS BIGINT) AS a, CAST(substr(dst, 2) AS BIGINT) AS b FROM links WHERE dst LIKE 'P%' AND src <> dst),
o AS (SELECT * FROM (VALUES (TRUE, TRUE), (TRUE, FALSE), (FALSE, TRUE), (FALSE, FALSE)) o(seeds, isolated)), k AS (SELECT seeds, isolated, p_partkey AS node FROM part, o WHERE seeds OR p_size >= 5),
ends AS (SELECT x.seeds, x.isolated, e.a, e.b FROM e JOIN k x ON x.node = a JOIN k y ON y.node = b AND y.seeds = x.seeds AND y.isolated = x.isolated)
SELECT * FROM k WHERE isolated OR EXISTS (SELECT 1 FROM ends WHERE ends.seeds = k.seeds AND ends.isolated = k.isolated AND (ends.a = k.node OR ends.b = k.node))"""))
def screen_backbone(spark, d):
    """Seeds go first, then edges without both ends, then nodes without an edge that is left."""
    e = LINKS.frame(spark, d).where("dst like 'P%' and src <> dst").select(F.substring("src", 2, 20).cast("long").alias("node"), F.substring("dst", 2, 20).cast("long").alias("other")).distinct()
    both = e.unionByName(e.select(F.col("other").alias("node"), F.col("node").alias("other")))
    grown = tbl(spark, d, "part").select(F.col("p_partkey").alias("other"), (F.col("p_size") >= 5).alias("grown"))
    degree = both.join(grown, "other").groupBy("node").agg(F.count("*").alias("deg"), F.count_if("grown").alias("grown_deg"))
    n = tbl(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_size").join(degree, "node", "left")
    options = F.array(*[F.struct(F.lit(s).alias("seeds"), F.lit(i).alias("isolated")) for s in (True, False) for i in (True, False)])
    left = F.coalesce(F.when(F.col("seeds"), F.col("deg")).otherwise(F.col("grown_deg")), F.lit(0))
    return n.select("*", F.inline(options)).where("seeds or p_size >= 5").where(F.col("isolated") | (left > 0)).select("seeds", "isolated", "node")


@query("d11_screen_cluster_summary", SQL("WITH i AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT p_brand AS cluster, p_partkey AS top, coalesce(n, 0) AS inbound, count(*) OVER (PARTITION BY p_brand) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(n, 0) DESC, p_size % 4, p_partkey) AS r FROM part LEFT JOIN i ON k = p_partkey) SELECT cluster, size, top, inbound FROM r WHERE r = 1"))
def screen_clusters(spark, d):
    inbound = tbl(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    p = tbl(spark, d, "part").select(F.col("p_brand").alias("cluster"), "p_partkey", "p_size").join(inbound, "p_partkey", "left").withColumn("inbound", F.coalesce("n", F.lit(0)))
    # the best member as a minimum that combines before the shuffle
    best = F.min(F.struct(-F.col("inbound"), F.col("p_size") % 4, "p_partkey", "inbound")).alias("b")
    return p.groupBy("cluster").agg(F.count("*").alias("size"), best).select("cluster", "size", F.col("b.p_partkey").alias("top"), F.col("b.inbound"))


_FEATURES = "f AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS feature, o_orderpriority = '1-URGENT' AS urgent FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query("d20_relevance_ratio", SQL(f"WITH {_FEATURES}, n AS (SELECT count(DISTINCT k) AS n, count(DISTINCT k) FILTER (urgent) AS u FROM f), w AS (SELECT feature, ln(1 + any_value(n) * 1.0 / count(*)) AS idf, count(*) FILTER (urgent) * 1.0 / any_value(u) AS share FROM f, n GROUP BY 1) SELECT k AS page, round(sum(idf * share) / sum(idf), 6) AS ratio FROM f JOIN w USING (feature) GROUP BY 1"))
def relevance(spark, d):
    o = tbl(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    f = tbl(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("feature")).distinct().join(o, "k")
    n = f.select("k", "urgent").distinct().agg(F.count("*").alias("n"), F.count_if("urgent").alias("u"))
    w = f.groupBy("feature").agg(F.count("*").alias("df"), F.count_if("urgent").alias("mine")).crossJoin(F.broadcast(n))
    w = w.select("feature", F.log(1 + F.col("n") / F.col("df")).alias("idf"), (F.col("mine") / F.col("u")).alias("share"))
    return f.join(w, "feature").groupBy(F.col("k").alias("page")).agg(F.round(F.sum(F.col("idf") * F.col("share")) / F.sum("idf"), 6).alias("ratio"))


@query("d28_weighted_mean_vector", SQL("""WITH c AS (SELECT vec_id // 3 AS page, greatest(1, strlen(coalesce(text, ''))) AS w, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
m AS (SELECT page, i, sum(w * x) / sum(w) AS x, count(*) AS chunks FROM c GROUP BY 1, 2) SELECT page, i, round(CASE WHEN chunks = 1 THEN x ELSE x / sqrt(sum(x * x) OVER (PARTITION BY page)) END, 5) AS x FROM m"""))
def mean_vectors(spark, d):
    """Three chunks make a page; a chunk weighs as many bytes as its text has."""
    size = tbl(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.octet_length("text").alias("bytes"))
    c = tbl(spark, d, "embeddings").join(size, "vec_id", "left").select(F.expr("vec_id div 3").alias("page"), F.greatest(F.lit(1), F.coalesce("bytes", F.lit(0))).alias("w"), F.posexplode("embedding").alias("i", "x"))
    x = F.col("x").cast("double")
    m = c.groupBy("page", (F.col("i") + 1).cast("long").alias("i")).agg((F.sum(F.col("w") * x) / F.sum("w")).alias("x"), F.count("*").alias("chunks"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("page")))
    return m.select("page", "i", F.round(F.when(F.col("chunks") == 1, F.col("x")).otherwise(F.col("x") / norm), 5).alias("x"))


@query("d32_capped_with_total", SQL("SELECT c_custkey AS page, c_acctbal AS score, count(*) OVER () AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 25"))
def capped(spark, d):
    c = tbl(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("page"), F.col("c_acctbal").alias("score"))
    return c.orderBy(F.desc("score"), "page").limit(25).crossJoin(F.broadcast(c.agg(F.count("*").alias("total"))))


@query("f5_member_sort", SQL("WITH i AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT p_brand AS cluster, p_partkey AS member, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 4, coalesce(n, 0) DESC, p_name, p_partkey) AS place FROM part LEFT JOIN i ON k = p_partkey"))
def members(spark, d):
    inbound = tbl(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    p = tbl(spark, d, "part").join(inbound, "p_partkey", "left")
    order = W.partitionBy("p_brand").orderBy(F.col("p_size") % 4, F.desc(F.coalesce("n", F.lit(0))), "p_name", "p_partkey")
    return p.select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("member"), F.row_number().over(order).alias("place"))


@query("f7_frontier_top", SQL("SELECT o_custkey AS page, round(sum(o_totalprice), 2) AS score FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING sum(o_totalprice) > 0 ORDER BY 2 DESC, 1 LIMIT 20"))
def frontier_top(spark, d):
    s = tbl(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("page")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "page").limit(20)


@query("f13_cluster_labels", SQL("WITH r AS (SELECT c_nationkey AS cluster, c_custkey AS page, c_acctbal AS size, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) SELECT cluster, page FROM r WHERE r = 1 ORDER BY size DESC, page LIMIT 40"))
def labels(spark, d):
    c = tbl(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.min(F.struct(-F.col("c_acctbal"), "c_custkey")).alias("b"))
    return c.orderBy("b").limit(40).select("cluster", F.col("b.c_custkey").alias("page"))


_LEDGERS = "l AS (SELECT lower(trim(c_name)) AS name, o_orderdate AS day, o_orderkey AS attempt, o_orderstatus AS state FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'O'))"


@query("g5_ledger_merge", SQL(f"WITH {_LEDGERS} SELECT name, min(day) AS first_seen, count(DISTINCT attempt) AS attempts, arg_max(state, (day, attempt)) AS state FROM l GROUP BY 1"))
def merged_ledgers(spark, d):
    o = tbl(spark, d, "orders").join(tbl(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    ledger = lambda s: o.where(F.col("o_orderstatus") == s).select(F.lower(F.trim("c_name")).alias("name"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("state"))
    both = ledger("F").unionByName(ledger("O"))
    return both.groupBy("name").agg(F.min("day").alias("first_seen"), F.countDistinct("attempt").alias("attempts"), F.max_by("state", F.struct("day", "attempt")).alias("state"))


@query("g6_archive_merge", SQL("WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-02'), n AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-02') SELECT n.event_id, row_number() OVER (PARTITION BY n.user_id ORDER BY n.ts DESC, n.event_id) AS place FROM n ANTI JOIN a ON a.user_id = n.user_id AND a.event_type = n.event_type"))
def archive(spark, d):
    e, cut = tbl(spark, d, "events"), F.lit("2024-01-02").cast("timestamp")
    fresh = e.where(F.col("ts") >= cut).join(e.where(F.col("ts") < cut).select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_anti")
    return fresh.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")).alias("place"))


@query("g7_expected_and_staged", SQL("WITH x AS (SELECT DISTINCT o_custkey AS k FROM orders), s AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT coalesce(x.k, s.k) AS page, CASE WHEN s.k IS NULL THEN 'missing' ELSE 'extra' END AS how FROM x FULL JOIN s ON x.k = s.k WHERE x.k IS NULL OR s.k IS NULL"))
def staged(spark, d):
    x = tbl(spark, d, "orders").select(F.col("o_custkey").alias("page")).distinct().withColumn("x", F.lit(1))
    s = tbl(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("page"), F.lit(1).alias("s"))
    return x.join(s, "page", "full").where("x is null or s is null").select("page", F.when(F.col("s").isNull(), "missing").otherwise("extra").alias("how"))


# What a claim's key leaves out: white space, punctuation of both scripts, brackets, quotes, markup, dashes.
LOOSE = r"[ \t\n\r\f\v\x{3000}。、，,．.・:：;；!！?？「」『』()（）\[\]【】\"''`*_~\-–—]"


@query("h27_loose_claim_key", SQL(f"SELECT doc_id, md5(regexp_replace(lower(text), '{LOOSE}', '', 'g')) AS loose FROM documents"))
def loose(spark, d):
    """Without white space, punctuation of both scripts and markup, folded for compatibility."""
    return tbl(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.md5(F.regexp_replace(TX.compatible_lower("text"), LOOSE.replace("''", "'"), ""))).alias("loose"))


@query("h33_compact_title", SQL("SELECT doc_id, CASE WHEN length(text) > 16 THEN left(text, 16) || '…' ELSE text END AS title FROM documents"))
def compact(spark, d):
    return tbl(spark, d, "documents").select("doc_id", F.when(F.length("text") > 16, F.concat(F.left("text", F.lit(16)), F.lit("…"))).otherwise(F.col("text")).alias("title"))


@query("h39_status_guess", SQL(f"SELECT doc_id, CASE WHEN source LIKE '%1' THEN 'held' WHEN {' OR '.join(f'contains(lower(text), {h!r})' for h in OPEN_HINTS)} THEN 'open' WHEN {' OR '.join(f'contains(lower(text), {h!r})' for h in EXPLAINED_HINTS)} THEN 'explained' ELSE 'open' END AS status FROM documents"))
def guessed(spark, d):
    hints = lambda hs: F.exists(F.array(*map(F.lit, hs)), lambda h: F.lower("text").contains(h))
    s = F.when(F.col("source").endswith("1"), "held").when(hints(OPEN_HINTS), "open").when(hints(EXPLAINED_HINTS), "explained").otherwise("open")
    return tbl(spark, d, "documents").select("doc_id", s.alias("status"))


@query("j9_guarded_percentages", SQL("SELECT c_custkey AS page, CASE WHEN count(o_orderkey) = 0 THEN '-' ELSE CAST(100 * count(*) FILTER (o_orderstatus = 'F') // count(o_orderkey) AS VARCHAR) END AS percent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"))
def percentages(spark, d):
    o = tbl(spark, d, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    c = tbl(spark, d, "customer").select(F.col("c_custkey").alias("page")).join(o, "page", "left")
    return c.select("page", F.coalesce(F.floor(F.try_divide(100 * F.col("f"), F.col("n"))).cast("string"), F.lit("-")).alias("percent"))


@query("k2_unique_targets", SQL("SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), lambda x: regexp_replace(lower(x), '^.*/', '')))), '|') AS targets FROM pages"))
def targets(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    names = F.transform(found, lambda x: F.regexp_replace(F.lower(x), "^.*/", ""))
    return tbl(spark, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(names)), "|").alias("targets"))


_RAW = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN lang ELSE '[' || lang || ', \"' || source || ', ' || lang || '\", ' || source || ']' END"


@query("k3_list_coercion", SQL(f"SELECT doc_id, CASE WHEN raw IS NULL OR raw = '' THEN [] WHEN raw[1] = '[' THEN list_transform(regexp_extract_all(raw, '\"[^\"]*\"|[^,\\[\\]\" ]+'), lambda x: trim(x, '\"')) ELSE [raw] END AS items FROM (SELECT doc_id, {_RAW} AS raw FROM documents)"))
def coerced(spark, d):
    """A null or an empty text is no item, a bare text one, a list its items."""
    raw = tbl(spark, d, "documents").selectExpr("doc_id", f"{_RAW} AS raw")
    items = F.transform(F.regexp_extract_all("raw", F.lit(r'"[^"]*"|[^,\[\]" ]+'), F.lit(0)), lambda x: F.btrim(x, F.lit('"')))
    several = F.when(F.col("raw").startswith("["), items).otherwise(F.array("raw"))
    return raw.select("doc_id", F.when(F.coalesce("raw", F.lit("")) == "", F.array().cast("array<string>")).otherwise(several).alias("items"))


@query("k4_inline_list", SQL(f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(raw, '\"[^\"]*\"|[^,\\[\\]\" ]+'), lambda x: trim(x, '\"')), '|') AS items FROM (SELECT doc_id, {_RAW} AS raw FROM documents) WHERE raw LIKE '[%'"))
def inline_list(spark, d):
    raw = tbl(spark, d, "documents").selectExpr("doc_id", f"{_RAW} AS raw").where("raw like '[%'")
    items = F.regexp_extract_all("raw", F.lit(r'"[^"]*"|[^,\[\]" ]+'), F.lit(0))
    return raw.select("doc_id", F.array_join(F.transform(items, lambda x: F.regexp_replace(x, '"', "")), "|").alias("items"))


@query("o1_newer_than_index", SQL("WITH i AS (SELECT user_id, max(ts) AS indexed FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id FROM events e LEFT JOIN i ON i.user_id = e.user_id WHERE indexed IS NULL OR ts > indexed"))
def newer(spark, d):
    e = tbl(spark, d, "events")
    i = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("indexed"))
    return e.join(i, "user_id", "left").where("indexed is null or ts > indexed").select("event_id")


@query("o4_rotation_lag", SQL("WITH m AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events), l AS (SELECT user_id, max(day) AS newest FROM m GROUP BY 1) SELECT l.user_id, newest, count(*) FILTER (day < newest) AS lagging FROM m JOIN l ON l.user_id = m.user_id GROUP BY 1, 2"))
def lag(spark, d):
    m = tbl(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    newest = m.groupBy("user_id").agg(F.max("day").alias("newest"))
    return m.join(newest, "user_id").groupBy("user_id", "newest").agg(F.sum(F.when(F.col("day") < F.col("newest"), F.col("n")).otherwise(0)).alias("lagging"))


@query("q10_target_union", SQL("SELECT p_partkey AS page, CASE WHEN p_partkey <= 5 THEN 'explicit' WHEN p_brand LIKE '%1' THEN 'glob' WHEN contains(p_type, 'STEEL') THEN 'changed' ELSE 'other' END AS how FROM part"))
def target_union(spark, d):
    p = tbl(spark, d, "part").select(F.col("p_partkey").alias("page"), "p_brand", "p_type")
    how = F.when(F.col("page") <= 5, "explicit").when(F.col("p_brand").endswith("1"), "glob").when(F.col("p_type").contains("STEEL"), "changed").otherwise("other")
    return p.select("page", how.alias("how"))


@query("q11_added_lines", SQL("WITH l AS (SELECT source, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS added FROM documents GROUP BY 1), x AS (SELECT source, count(*) AS expected FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT l.source, added, coalesce(expected, 0) AS expected, added >= coalesce(expected, 0) AS enough FROM l LEFT JOIN x ON x.source = l.source"))
def added(spark, d):
    docs = tbl(spark, d, "documents").select("doc_id", "source", F.size(F.split("text", "\n", -1)).alias("n"))
    labelled = tbl(spark, d, "labels").select("doc_id").withColumn("on", F.lit(1))
    x = docs.join(labelled, "doc_id", "left").groupBy("source").agg(F.count("on").alias("expected"))
    return docs.groupBy("source").agg(F.sum("n").alias("added")).join(x, "source").select("source", "added", "expected", (F.col("added") >= F.col("expected")).alias("enough"))


@query("q47_cluster_or_reason", SQL("WITH e AS (SELECT DISTINCT l_partkey AS n FROM lineitem) SELECT p_partkey AS page, CASE WHEN n IS NOT NULL AND p_size >= 5 THEN p_brand WHEN p_size < 5 THEN 'seed' ELSE 'isolated' END AS cluster FROM part LEFT JOIN e ON n = p_partkey"))
def cluster_or_reason(spark, d):
    linked = tbl(spark, d, "lineitem").select(F.col("l_partkey").alias("page")).distinct().withColumn("on", F.lit(True))
    p = tbl(spark, d, "part").select(F.col("p_partkey").alias("page"), "p_size", "p_brand").join(linked, "page", "left")
    return p.select("page", F.when(F.col("on") & (F.col("p_size") >= 5), F.col("p_brand")).when(F.col("p_size") < 5, "seed").otherwise("isolated").alias("cluster"))
