"""Claim audit over ``benchmark`` and ``documents``, and callouts built from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.operators import claims as C
from lakequill.plans.registry import SQL, query, tbl

TOKENS = f"list_distinct(list_transform(regexp_extract_all(text, '{C.WORD}'), lambda w: lower(w)))"
# lines stand for paragraphs, as the supplied texts have no empty lines
PARAS = f"""l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS place, string_split(text, chr(10)) AS ls FROM documents),
b AS (SELECT doc_id, place, trim(regexp_replace(ls[place + 1], '\\s+', ' ', 'g')) AS text FROM l),
w AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM b WHERE length(text) >= {C.LEAST}),
p AS (SELECT doc_id, place, text, {TOKENS} AS pt FROM w WHERE len(ws) >= 6 AND len(list_filter(ws, lambda x: regexp_matches(x, '{C.NUMERIC}'))) / len(ws) <= 0.35)"""


def _paras(spark, d):
    return C.paragraphs(tbl(spark, d, "documents"), "doc_id", "text", "\n").withColumn("pt", C.audit_tokens("body"))


@query("h3_audit_tokens", SQL(f"SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n_tokens, list_sort({TOKENS}) AS tokens FROM documents"))
def audit_tokens(spark, d):
    t = tbl(spark, d, "documents").select("doc_id", C.audit_tokens("text").alias("tokens"))
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.sort_array("tokens").alias("tokens"))


@query("f14_best_paragraphs", SQL(f"""WITH {PARAS}, pt AS (SELECT doc_id, place, len(pt) AS n, unnest(pt) AS term FROM p), c AS (SELECT item_id AS claim, unnest({TOKENS}) AS term FROM benchmark),
o AS (SELECT claim, doc_id, place, n, count(*) AS overlap FROM c JOIN pt USING (term) GROUP BY ALL)
SELECT claim, doc_id, CAST(place AS INTEGER) AS place, CAST(overlap AS INTEGER) AS overlap, round(overlap / sqrt(n), 6) AS score, CAST(row_number() OVER (PARTITION BY claim ORDER BY overlap / sqrt(n) DESC, doc_id, place) AS INTEGER) AS rank FROM o QUALIFY rank <= {C.TOP}"""))
def best_paragraphs(spark, d):
    claims = tbl(spark, d, "benchmark").select(F.col("item_id").alias("claim"), C.audit_tokens("text").alias("ct"))
    return C.best_paragraphs(claims, _paras(spark, d).select("doc_id", "place", "pt")).withColumn("score", F.round("score", 6))


# every document is cited by one passage: the one of the number that its id leaves over
@query("q20_evidence_packet", SQL(f"""WITH {PARAS}, k AS (SELECT count(*) AS k FROM benchmark), n AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark),
cite AS (SELECT item_id, {TOKENS.replace('text', 'n.text')} AS ct, doc_id, CASE WHEN length(trim(coalesce(d.text, ''))) < {C.STUB} THEN 'stub' ELSE 'ok' END AS status FROM documents d, k JOIN n ON n.i = d.doc_id % k.k),
o AS (SELECT item_id, doc_id, place, p.text, pt, len(list_intersect(ct, pt)) AS overlap FROM cite JOIN p USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap / sqrt(len(pt)) DESC, place) AS rank FROM o WHERE overlap > 0 QUALIFY rank <= {C.TOP})
SELECT cite.item_id, doc_id, status, CAST(r.rank AS INTEGER) AS rank, round(overlap / sqrt(len(pt)), 3) AS score, CASE WHEN length(r.text) <= {C.EXCERPT} THEN r.text ELSE left(r.text, {C.EXCERPT - 1}) || '…' END AS excerpt FROM cite LEFT JOIN r USING (doc_id)"""))
def evidence_packet(spark, d):
    """For each cited page its state and its three best paragraphs; a page without any stands alone."""
    bench = tbl(spark, d, "benchmark")
    k = bench.agg(F.count("*").alias("k"))
    below = bench.select(F.col("item_id").alias("x"))
    order = bench.join(below, F.col("x") < F.col("item_id"), "left").groupBy("item_id").agg(F.count("x").alias("i"))  # the passages are few: a fixed set
    claims = bench.select("item_id", C.audit_tokens("text").alias("ct")).join(order, "item_id")
    docs = tbl(spark, d, "documents").crossJoin(F.broadcast(k)).withColumn("i", F.col("doc_id") % F.col("k"))
    status = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < C.STUB, "stub").otherwise("ok")
    cite = docs.select("doc_id", "i", status.alias("status")).join(claims, "i").select("item_id", "doc_id", "ct", "status")
    best = C.ranked_within(cite.select("doc_id", "ct").join(_paras(spark, d), "doc_id"), ["doc_id"], ["place"])
    best = best.select("doc_id", "rank", F.round("score", 3).alias("score"), C.excerpt("body").alias("excerpt"))
    return cite.select("item_id", "doc_id", "status").join(best, "doc_id", "left")


# a callout is an order: its first part is the host, the other parts are the pages it names, its suppliers the sources
CALLOUTS = """c AS (SELECT l_orderkey AS id, arg_min(l_partkey, (l_linenumber, l_partkey)) AS hp FROM lineitem GROUP BY l_orderkey),
callouts AS (SELECT id, 'p' || hp AS host FROM c JOIN part ON p_partkey = hp WHERE p_size > 3),
mentions AS (SELECT DISTINCT l_orderkey AS id, 'p' || l_partkey AS name, FALSE AS is_source FROM lineitem JOIN c ON id = l_orderkey WHERE l_partkey <> hp UNION SELECT DISTINCT l_orderkey, 's' || l_suppkey, TRUE FROM lineitem),
parties AS (SELECT 'p' || p_partkey AS party, CASE WHEN p_size > 25 THEN 'concept' ELSE 'entity' END AS party_type FROM part WHERE p_size > 3)"""


@query("c23_one_sided_callouts", SQL(f"""WITH {CALLOUTS}, pair AS (SELECT host, party, party_type, min(id) AS id FROM callouts JOIN mentions USING (id) JOIN parties ON name = party WHERE party <> host GROUP BY ALL),
own AS (SELECT DISTINCT host, name, is_source FROM callouts JOIN mentions USING (id))
SELECT id, host, party, party_type FROM pair WHERE NOT (EXISTS (SELECT 1 FROM own WHERE own.host = pair.party AND own.name = pair.host)
 OR EXISTS (SELECT 1 FROM own JOIN mentions m ON m.name = own.name AND m.is_source AND own.is_source WHERE own.host = pair.party AND m.id = pair.id)
 OR EXISTS (SELECT 1 FROM own JOIN mentions m ON m.name = own.name AND NOT m.is_source AND NOT own.is_source WHERE own.host = pair.party AND m.id = pair.id))"""))
def one_sided(spark, d):
    li, part = tbl(spark, d, "lineitem"), tbl(spark, d, "part")
    first = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("hp"))
    name = lambda p, c: F.concat(F.lit(p), c)
    hosts = part.where("p_size > 3").select(F.col("p_partkey").alias("hp"))
    callouts = first.join(hosts, "hp").select("id", name("p", "hp").alias("host"))
    lines = li.select(F.col("l_orderkey").alias("id"), "l_partkey", "l_suppkey")
    pages = lines.join(first, "id").where("l_partkey <> hp").select("id", name("p", "l_partkey").alias("name"), F.lit(False).alias("is_source")).distinct()
    sources = lines.select("id", name("s", "l_suppkey").alias("name"), F.lit(True).alias("is_source")).distinct()
    parties = part.where("p_size > 3").select(name("p", "p_partkey").alias("party"), F.when(F.col("p_size") > 25, "concept").otherwise("entity").alias("party_type"))
    return C.one_sided(callouts, pages.unionByName(sources), parties)
