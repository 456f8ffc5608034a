"""Retrieval: index statistics, BM25, dense search, ranks and their fusion. Query sets are DataFrames, so all queries run at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.sources.tables import checkpointed

K1, B, RRF = 1.5, 0.75, 60
#: Distinct query terms that are broadcast at most.
SENT_TERMS = 200_000


def token_rows(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    return docs.select(key, F.explode(tokens).alias("term"))


def counted(ws: Column) -> Column:
    """``array<struct<term string, tf long>>``: each word of an array once, with its number; a null array gives an empty one. A text's words are sorted in its own row, so that nothing is shuffled."""
    starts = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, F.greatest(i - 2, F.lit(0)))))
    runs = lambda x: F.transform(x["s"], lambda b, k: F.struct(F.get(x["w"], b - 1).alias("term"), (F.coalesce(F.get(x["s"], k + 1), F.size(x["w"]) + 1) - b).cast("long").alias("tf")))
    # arrays of one element, so that each is made once a row
    kept = F.transform(F.array(F.sort_array(F.filter(ws, lambda w: w.isNotNull()))), lambda w: F.struct(w.alias("w"), F.when(F.size(w) > 0, starts(w)).otherwise(F.array().cast("array<int>")).alias("s")))
    return F.flatten(F.transform(kept, runs))


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``(term, key, tf, dl)``: the inverted index, laid out for partitioning by term."""
    with_len = docs.select(key, tokens.alias("ts")).withColumn("dl", F.size("ts"))
    return with_len.select(key, "dl", F.explode("ts").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def collection(docs: DataFrame, tokens: Column) -> DataFrame:
    """``(n_docs, avgdl)``; documents without tokens count, an empty average is 1."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens)).alias("avgdl")).select("n_docs", F.when(F.coalesce("avgdl", F.lit(0.0)) == 0, 1.0).otherwise(F.col("avgdl")).alias("avgdl"))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, key: str, query: str) -> DataFrame:
    """``(query, key, score)`` for all documents that share a term; ``queries`` has a row per query token, so a doubled token counts twice.

    Only postings of query terms are kept, by a join on the term; the collection's row is the one broadcast.
    """
    return bm25_parts(index.join(queries.select("term").distinct(), "term", "left_semi"), stats, queries, key, query)


def bm25_parts(hits: DataFrame, stats: DataFrame, queries: DataFrame, key: str, query: str) -> DataFrame:
    """:func:`bm25` over ``hits(term, key, tf, dl)``, the postings of all query terms."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.groupBy(query, "term").agg(F.count("*").alias("times"))
    hit = hits.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))
    return hit.groupBy(query, key).agg(F.round(F.sum(_part() * F.col("times")), 6).alias("score"))


def _part() -> Column:
    """What one word gives to the score of a document."""
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def scored(docs: DataFrame, key: str, tokens: Column, queries: DataFrame, query: str) -> DataFrame:
    """:func:`bm25` of ``docs`` whose texts are read and cut into words once.

    Each document gives its counts of the queries' words, as numbers, and one row for itself under number nought, of
    which the collection's row is made. The counts lie together by document, so that a score is summed where they lie:
    pairs of query and document are not shuffled. The queries' words are counted; up to ``SENT_TERMS`` they are broadcast.
    """
    wanted = checkpointed(queries.select("term").where("term is not null").distinct().select("term", (F.monotonically_increasing_id() + 1).alias("word")))
    few = wanted.count() <= SENT_TERMS
    own = wanted.select("term", "word").unionByName(docs.sparkSession.createDataFrame([("", 0)], "term string, word long"))
    none = F.array().cast("array<string>")
    words = docs.select(key, tokens.alias("ts")).select(key, F.size("ts").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.coalesce("ts", none))).alias("term"))
    held = words.join(F.broadcast(own) if few else own, "term").groupBy(key, "dl", "word").agg(F.count("*").alias("tf"))
    held = checkpointed(held)
    stats = held.where("word = 0").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl").cast("long") * F.col("tf")) / F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).alias("avgdl"))
    stats = stats.select("n_docs", F.when(F.coalesce("avgdl", F.lit(0.0)) == 0, 1.0).otherwise(F.col("avgdl")).alias("avgdl"))
    hits = held.where("word > 0")
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    asked = queries.groupBy(query, "term").agg(F.count("*").alias("times")).join(wanted, "term").join(df, "word").crossJoin(stats)
    asked = checkpointed(asked.select(query, "word", "times", "n_docs", "avgdl", "df"))
    hit = hits.repartition(key).join(F.broadcast(asked) if asked.count() <= SENT_TERMS else asked, "word")
    return hit.groupBy(query, key).agg(F.round(F.sum(_part() * F.col("times")), 6).alias("score"))


def ranked(df: DataFrame, by: list, order: list, name: str = "rank", base: int = 1) -> DataFrame:
    """A gapless rank inside each group; the order given must break all ties."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)) + (base - 1))


def top_k(df: DataFrame, by: list, order: list, k: int) -> DataFrame:
    return ranked(df, by, order).where(F.col("rank") <= k)


def best_per(df: DataFrame, by: list, order: list) -> DataFrame:
    return top_k(df, by, order, 1).drop("rank")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Nought where lengths differ or a norm is nought."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def l2_normalized(a: str) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def rounded(x: Column, places: int) -> Column:
    """Rounded half away from nought on the scaled value, as SQL does it on doubles; what comes to nought keeps its sign."""
    return F.signum(x) * (F.round(F.abs(x) * float(10**places)) / float(10**places))


def rrf(*ranks: Column) -> Column:
    """Reciprocal rank fusion; a missing rank gives nothing."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(1.0 / (RRF + r), F.lit(0.0))
    return out
