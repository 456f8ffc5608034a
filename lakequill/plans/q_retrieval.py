"""Retrieval queries over ``documents``, ``benchmark`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.operators import retrieval as R
from lakequill.operators import tiles as TI
from lakequill.plans.registry import SQL, query, tbl
from lakequill.sources.tables import checkpointed

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOK = f"list_filter(regexp_extract_all(lower(text), '{T.LATIN}'), lambda w: length(w) > 1 AND w NOT IN ({STOP}))"
BASE = f"""
d AS (SELECT doc_id, {TOK} AS ts FROM documents),
t AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
st AS (SELECT count(*) AS n, CASE WHEN coalesce(avg(len(ts)), 0) = 0 THEN 1 ELSE avg(len(ts)) END AS avgdl FROM d),
q AS (SELECT item_id, unnest({TOK}) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM qt JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def _docs(spark, d):
    return tbl(spark, d, "documents").select("doc_id", "lang", "source", "text")


def _scores(spark, d):
    docs, toks = _docs(spark, d), T.latin_tokens("text")
    asked = R.token_rows(tbl(spark, d, "benchmark"), "item_id", toks)
    return R.scored(docs, "doc_id", toks, asked, "item_id")


def _bm():
    return [F.desc("score"), "doc_id"]


@query("d1_index_statistics", SQL(f"WITH {BASE} SELECT term, df, (SELECT CAST(sum(tf) AS BIGINT) FROM p x WHERE x.term = df.term) AS cf FROM df"))
def index_statistics(spark, d):
    p = R.postings(_docs(spark, d), "doc_id", T.latin_tokens("text"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("d1_collection", SQL(f"WITH {BASE} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM st"))
def collection(spark, d):
    return R.collection(_docs(spark, d), T.latin_tokens("text")).withColumn("avgdl", F.round("avgdl", 6))


@query("f1_bm25_topk", SQL(f"WITH {BASE} SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"))
def bm25_topk(spark, d):
    return R.top_k(_scores(spark, d), ["item_id"], _bm(), 10)


@query("c10_best_chunk_per_page", SQL(f"""WITH {BASE}, x AS (SELECT item_id, lang, doc_id, score, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS r
 FROM s JOIN documents USING (doc_id)) SELECT item_id, lang, doc_id, score FROM x WHERE r = 1"""))
def best_chunk(spark, d):
    s = _scores(spark, d).join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    return R.best_per(s, ["item_id", "lang"], [F.desc("score"), F.desc(F.col("doc_id").cast("string"))]).select("item_id", "lang", "doc_id", "score")


@query("e5_dedupe_best_per_group", SQL(f"""WITH {BASE}, x AS (SELECT item_id, source, doc_id, score, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS r
 FROM s JOIN documents USING (doc_id)) SELECT item_id, source, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE r = 1"""))
def dedupe(spark, d):
    s = _scores(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return R.ranked(R.best_per(s, ["item_id", "source"], _bm()), ["item_id"], _bm()).select("item_id", "source", "doc_id", "score", "rank")


@query("e1_rank_ties_in_order", SQL("SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders"))
def rank_of(spark, d):
    return R.ranked(tbl(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"])


# two channels: BM25 top 50, and pages boosted by a source that the best documents share
CHANNELS = f"""WITH {BASE},
b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS br FROM s QUALIFY br < 50),
g0 AS (SELECT item_id, source, sum(1.0 / (br + 1)) AS w FROM b JOIN documents USING (doc_id) WHERE br < 5 GROUP BY ALL),
g AS (SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY round(w, 6) DESC, source) - 1 AS gr FROM g0)"""


def _channels(spark, d):
    docs = _docs(spark, d).select("doc_id", "source")
    # fifty rows a query, used several times: scored once
    b = checkpointed(R.ranked(_scores(spark, d), ["item_id"], _bm(), "br", 0).where("br < 50").select("item_id", "doc_id", "br"))
    g = b.where("br < 5").join(docs, "doc_id").groupBy("item_id", "source").agg(F.sum(1.0 / (F.col("br") + 1)).alias("w"))
    g = R.ranked(g, ["item_id"], [F.desc(F.round("w", 6)), "source"], "gr", 0).select("item_id", "source", "gr")
    return docs, b, g


@query("e2_rrf_two_channels", SQL(CHANNELS + """
SELECT item_id, doc_id, round(1.0 / (60 + br) + coalesce(1.0 / (60 + gr), 0), 8) AS fused,
 CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(1.0 / (60 + br) + coalesce(1.0 / (60 + gr), 0), 8) DESC, br) AS INTEGER) AS rank
FROM b JOIN documents USING (doc_id) LEFT JOIN g USING (item_id, source)"""))
def rrf_two(spark, d):
    docs, b, g = _channels(spark, d)
    f = b.join(docs, "doc_id").join(g, ["item_id", "source"], "left").withColumn("fused", F.round(R.rrf(F.col("br"), F.col("gr")), 8))
    return R.ranked(f, ["item_id"], [F.desc("fused"), "br"]).select("item_id", "doc_id", "fused", "rank")


@query("g1_channel_union", SQL(CHANNELS + """, lead AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source),
add AS (SELECT item_id, l.doc_id, gr FROM g JOIN lead l USING (source) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.item_id = g.item_id AND b.doc_id = l.doc_id))
SELECT item_id, doc_id, 'bm25' AS channel, CAST(br AS INTEGER) AS position FROM b UNION ALL SELECT item_id, doc_id, 'graph', CAST(gr AS INTEGER) FROM add"""))
def channel_union(spark, d):
    docs, b, g = _channels(spark, d)
    lead = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    add = g.join(lead, "source").join(b.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    return b.select("item_id", "doc_id", F.lit("bm25").alias("channel"), F.col("br").alias("position")).unionByName(add.select("item_id", "doc_id", F.lit("graph").alias("channel"), F.col("gr").alias("position")))


@query("e4_rrf_multi_query", SQL(f"""WITH {BASE}, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 30),
w AS (SELECT item_id // 4 AS family, item_id, doc_id, rank, CASE WHEN item_id % 4 = 0 THEN 2.0 ELSE 1.0 END AS weight FROM r)
SELECT family, doc_id, round(sum(weight / (60 + rank)), 8) AS fused, CAST(min(rank) AS INTEGER) AS best_rank, count(*) AS matched FROM w GROUP BY ALL"""))
def rrf_multi(spark, d):
    r = R.top_k(_scores(spark, d), ["item_id"], _bm(), 30)
    w = r.withColumn("family", F.floor(F.col("item_id") / 4)).withColumn("weight", F.when(F.col("item_id") % 4 == 0, 2.0).otherwise(1.0))
    return w.groupBy("family", "doc_id").agg(F.round(F.sum(F.col("weight") / (R.RRF + F.col("rank"))), 8).alias("fused"), F.min("rank").alias("best_rank"), F.count("*").alias("matched"))


# queries are the vectors whose id is divisible by 100
DENSE = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT q.vec_id AS query_id, q.label AS q_label, v.vec_id, v.label,
  CASE WHEN sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(v.e, lambda x: x * x))) = 0 THEN 0 ELSE
  list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(v.e, lambda x: x * x)))) END AS cos
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)"""


def _vectors(spark, d):
    return tbl(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


#: The stated queries.
ASKED = "id % 100 = 0"


@query("f2_dense_topk", SQL(DENSE + " SELECT query_id, vec_id, round(cos, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 6) DESC, vec_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 20"))
def dense_topk(spark, d):
    return R.top_k(TI.nearest(_vectors(spark, d), ASKED, 20), ["query_id"], [F.desc("score"), "vec_id"], 20)


@query("j1_cosine", SQL(DENSE + " SELECT query_id, label, count(*) AS n, round(avg(cos), 6) AS mean_cos, round(max(cos), 6) AS best FROM c GROUP BY ALL"))
def cosine(spark, d):
    return TI.by_label(_vectors(spark, d), ASKED).groupBy("query_id", "label").agg(F.sum("n").alias("n"), R.rounded(F.sum("total") / F.nullif(F.sum("held"), F.lit(0)), 6).alias("mean_cos"), R.rounded(F.max("best"), 6).alias("best"))


@query("j2_l2_normalize", SQL("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v) SELECT vec_id, round(n, 6) AS norm, list_transform(e, lambda x: round(CASE WHEN n = 0 THEN x ELSE x / n END, 6)) AS unit FROM n"))
def l2_normalize(spark, d):
    """Missing components do not count for the norm; a vector without components has none."""
    held = F.filter("embedding", lambda x: x.isNotNull())
    v = tbl(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.size(held) > 0, R.norm(held)).alias("n"))
    unit = F.transform("embedding", lambda x: R.rounded(F.when(F.col("n") == 0, x.cast("double")).otherwise(x.cast("double") / F.col("n")), 6))
    return v.select("vec_id", R.rounded(F.col("n"), 6).alias("norm"), unit.alias("unit"))


# a passage's vector is the one of its number, a document's the one of its id
PAGE_COS = """pc AS (SELECT q.vec_id AS item_id, v.vec_id AS doc_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x)))) AS c,
 list_sum(list_transform(list_zip(q.embedding[1:16], v.embedding[1:16]), lambda z: CAST(z[1] AS DOUBLE) * z[2])) AS lead FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark))"""


#: Vectors of passages that are broadcast at most.
SENT_VECTORS = 10_000


def _with_vectors(spark, d, scored):
    """``scored`` with the cosine of passage and document, and the product of the first sixteen components; null where there is no vector."""
    v = tbl(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    asked = v.join(tbl(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = asked.select(F.col("vec_id").alias("item_id"), F.col("e").alias("qe"))
    few = asked.limit(SENT_VECTORS + 1).count() <= SENT_VECTORS
    # the pair is shuffled without vectors; a document's comes to it by its id, and then the passage's
    both = scored.join(v.select(F.col("vec_id").alias("doc_id"), "e").hint("merge"), "doc_id", "left").join(F.broadcast(asked) if few else asked, "item_id", "left")
    lead = R.dot(F.slice("qe", 1, 16), F.slice("e", 1, 16))
    return both.withColumn("c", R.cosine(F.col("qe"), F.col("e"))).withColumn("c", F.when(F.col("qe").isNotNull() & F.col("e").isNotNull(), F.col("c"))).withColumn("lead", lead).drop("qe", "e")


@query("j3_page_score_or_minus_one", SQL(f"WITH {BASE}, {PAGE_COS} SELECT s.item_id, s.doc_id, round(coalesce(c, -1), 6) AS page_score FROM s LEFT JOIN pc USING (item_id, doc_id)"))
def page_score(spark, d):
    return _with_vectors(spark, d, _scores(spark, d).select("item_id", "doc_id")).select("item_id", "doc_id", F.round(F.coalesce("c", F.lit(-1.0)), 6).alias("page_score"))


@query("e3_rrf_three_channels", SQL(f"""WITH {BASE}, {PAGE_COS}, b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS i FROM s QUALIFY i <= 50),
x AS (SELECT item_id, doc_id, i, score, round(coalesce(c, -1), 9) AS dense, round(coalesce(lead, 0), 9) AS rerank FROM b LEFT JOIN pc USING (item_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, i) AS rb, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, i) AS rd, row_number() OVER (PARTITION BY item_id ORDER BY rerank DESC, i) AS rr FROM x)
SELECT item_id, doc_id, round(1.0 / (60 + rb) + 1.0 / (60 + rd) + 1.0 / (60 + rr), 6) AS fused FROM r"""))
def rrf_three(spark, d):
    """BM25, the documents' vectors, and the vectors' leading components as the reranker."""
    b = R.ranked(_scores(spark, d), ["item_id"], _bm(), "i").where("i <= 50")
    x = _with_vectors(spark, d, b).withColumn("dense", F.round(F.coalesce("c", F.lit(-1.0)), 9)).withColumn("rerank", F.round(F.coalesce("lead", F.lit(0.0)), 9))
    for name, by in (("rb", "score"), ("rd", "dense"), ("rr", "rerank")):
        x = R.ranked(x, ["item_id"], [F.desc(by), "i"], name)
    return x.select("item_id", "doc_id", F.round(R.rrf(F.col("rb"), F.col("rd"), F.col("rr")), 6).alias("fused"))


@query("g2_ordered_union_dedupe", SQL(f"""WITH {BASE}, pin AS (SELECT doc_id, 0 AS src, doc_id AS pos FROM labels WHERE quality = 1 AND toxic = 0),
ret AS (SELECT doc_id, 1 AS src, min(-score) AS pos FROM s GROUP BY doc_id), ex AS (SELECT doc_id FROM labels WHERE toxic = 1),
u AS (SELECT doc_id, src, CAST(pos AS DOUBLE) AS pos FROM pin UNION ALL SELECT doc_id, src, CAST(pos AS DOUBLE) FROM ret)
SELECT doc_id, CAST(src AS INTEGER) AS src FROM u WHERE doc_id NOT IN (SELECT doc_id FROM ex) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY src, pos) = 1"""))
def ordered_union(spark, d):
    lab = tbl(spark, d, "labels")
    pin = lab.where("quality = 1 and toxic = 0").select("doc_id", F.lit(0).alias("src"), F.col("doc_id").cast("double").alias("pos"))
    ret = _scores(spark, d).groupBy("doc_id").agg(F.min(-F.col("score")).alias("pos")).select("doc_id", F.lit(1).alias("src"), "pos")
    u = pin.unionByName(ret).join(lab.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return R.best_per(u, ["doc_id"], ["src", "pos"]).select("doc_id", "src")


@query("h32_snippet", SQL("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(left(text, 200), '[ \\t\\n\\x0B\\f\\r]+$', '') || '…' END AS snippet FROM documents"))
def snippets(spark, d):
    return _docs(spark, d).select("doc_id", T.snippet("text").alias("snippet"))


@query("h34_token_estimates", SQL(r"SELECT doc_id, greatest(1, length(text) // 3) AS by_thirds, CAST(ceil(length(regexp_replace(text, '\s', '', 'g')) / 4) AS BIGINT) AS by_script FROM documents"))
def token_estimates(spark, d):
    return _docs(spark, d).select("doc_id", T.tokens_by_thirds("text").alias("by_thirds"), T.tokens_by_script("text").alias("by_script"))


@query("h2_stopword_filter", SQL(f"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{T.LATIN}')) AS INTEGER) AS words, CAST(len({TOK}) AS INTEGER) AS kept FROM documents"))
def stopwords(spark, d):
    return _docs(spark, d).select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit(f"({T.LATIN})"), F.lit(1))).alias("words"), F.size(T.latin_tokens("text")).alias("kept"))


@query("h1_mixed_script_tokens", None)
def mixed_tokens(spark, d):
    return _docs(spark, d).select("doc_id", T.tokens_udf("text").alias("tokens"))


@query("f3_candidate_multi_key_sort", SQL("SELECT p_partkey, p_type, CAST(row_number() OVER (ORDER BY CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END, p_retailprice DESC, p_type, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 100"))
def multi_key(spark, d):
    p = tbl(spark, d, "part").select("p_partkey", "p_type", F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 30, 1).otherwise(2).alias("m"), "p_retailprice")
    order = ["m", F.desc("p_retailprice"), "p_type", "p_partkey"]
    return R.ranked(p.orderBy(*order).limit(100).withColumn("one", F.lit(1)), ["one"], order).select("p_partkey", "p_type", "rank")
