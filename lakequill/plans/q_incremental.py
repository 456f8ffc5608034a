"""Queries over indexes that are fed batch by batch: the same rows as one full build, and what each refresh did."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.operators import retrieval as R
from lakequill.plans.q_retrieval import TOK
from lakequill.plans.registry import SQL, query, tbl
from lakequill.sources.tables import new_folder
from lakequill.streaming.incremental import TermIndex, VectorTable, refresh

FEED = "doc_id long, text string, deleted boolean, seq long"
ROUNDS = 10
# A page comes as a draft (every third) or whole, then again some batches later, whole; in the last batch toxic pages are taken back.
LIVE = "live AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"


def _feed(spark, d, batch):
    """The rows of one batch, by one pass over the documents."""
    docs = tbl(spark, d, "documents").select("doc_id", "text")
    first = F.pmod("doc_id", F.lit(ROUNDS - 1)).cast("int")
    later = F.least(F.lit(ROUNDS - 1), first + F.pmod("doc_id", F.lit(4)).cast("int"))
    draft = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("draft "), F.substring("text", 1, 200))).otherwise(F.col("text"))
    row = lambda text, seq, at: F.when(at == batch, F.struct(text.alias("text"), F.lit(False).alias("deleted"), F.lit(seq).cast("long").alias("seq")))
    come = docs.where((first == batch) | (later == batch)).select("doc_id", F.explode(F.array_compact(F.array(row(draft, 0, first), row(F.col("text"), 1, later)))).alias("x")).select("doc_id", "x.*")
    if batch < ROUNDS - 1:
        return come
    return come.unionByName(tbl(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"), F.lit(2).cast("long").alias("seq")))


def _fed(spark, d, make):
    """An index made by ``make(folder)`` and refreshed ten times, each by a query started anew on one checkpoint."""
    folder = new_folder(spark, "refresh")
    index = make(folder)
    for b in range(ROUNDS):
        _feed(spark, d, b).write.parquet(f"{folder}/in/round-{b}")
        refresh(spark, f"{folder}/in", FEED, f"{folder}/query", index)
    return index


def _terms(spark, d):
    return _fed(spark, d, lambda folder: TermIndex(spark, folder, T.latin_tokens))


@query("p3_incremental_postings", SQL(f"""WITH {LIVE}, t AS (SELECT doc_id, unnest({TOK}) AS term FROM live), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(sum(doc_id % 1000) AS BIGINT) AS ids FROM p GROUP BY term"""))
def postings(spark, d):
    """Every term's document and collection frequency in the refreshed index."""
    return _terms(spark, d).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum(F.col("doc_id") % 1000).alias("ids"))


@query("p3_incremental_bm25", SQL(f"""WITH {LIVE}, d AS (SELECT doc_id, {TOK} AS ts FROM live), t AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
st AS (SELECT count(*) AS n, CASE WHEN coalesce(avg(len(ts)), 0) = 0 THEN 1 ELSE avg(len(ts)) END AS avgdl FROM d),
q AS (SELECT item_id, unnest({TOK}) AS term FROM benchmark), qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""))
def incremental_bm25(spark, d):
    """BM25 over the refreshed index; only buckets of query terms are read."""
    asked = R.token_rows(tbl(spark, d, "benchmark"), "item_id", T.latin_tokens("text"))
    return R.top_k(_terms(spark, d).bm25(asked, "item_id"), ["item_id"], [F.desc("score"), "doc_id"], 10)


@query("p4_embedding_reuse", SQL(f"""WITH {LIVE}, x AS (SELECT doc_id, text, doc_id % 3 = 0 AND doc_id % 4 <> 0 AND (doc_id % 9 + doc_id % 4 <= 9) AND doc_id % 9 + doc_id % 4 > doc_id % 9 AS apart FROM live),
s AS (SELECT doc_id, text, CASE WHEN apart AND 'draft ' || substr(text, 1, 200) <> text THEN 2 ELSE 1 END AS made FROM x)
SELECT s.doc_id, CAST(made AS BIGINT) AS made, sha256(text) AS hash, CAST(len(embedding) AS INTEGER) AS dims, label FROM s LEFT JOIN embeddings ON vec_id = doc_id"""))
def embedding_reuse(spark, d):
    """How often each page has been embedded in ten refreshes; the supplied vectors stand for the embedder."""
    vectors = tbl(spark, d, "embeddings")

    def embed(pages):
        return pages.join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec")), "doc_id").select("doc_id", "vec")

    index = _fed(spark, d, lambda folder: VectorTable(spark, folder, embed))
    rows = index.history().select("doc_id", "made").join(index.vectors().select("doc_id", "hash", F.when(F.col("vec").isNotNull(), F.size("vec")).alias("dims")), "doc_id")
    return rows.join(vectors.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
