"""Steps that read or made the same thing several times: paragraphs of claims, words of scored documents."""

from pyspark.sql import functions as F

from lakequill.operators import claims as C
from lakequill.operators import retrieval as R


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paragraphs_are_read_once(spark):
    paras = spark.range(6).select(F.col("id").alias("doc_id"), F.lit(0).alias("place"), F.array(F.lit("a"), F.concat(F.lit("w"), F.col("id") % 3)).alias("pt"))
    claims = spark.createDataFrame([(1, ["a", "w1"]), (2, ["w2", "none"])], "claim long, ct array<string>")
    out = C.best_paragraphs(claims, paras)
    assert "Range (" not in _plan(out)
    got = sorted((r.claim, r["rank"], r.doc_id, r.overlap) for r in out.collect())
    assert got == [(1, 1, 1, 2), (1, 2, 4, 2), (1, 3, 0, 1), (2, 1, 2, 1), (2, 2, 5, 1)]


def test_paragraphs_beyond_what_is_sent(spark, monkeypatch):
    rows = [(d, p, [f"w{k}" for k in range(d, d + p + 1)]) for d in range(8) for p in range(3)]
    claims = spark.createDataFrame([(c, [f"w{k}" for k in range(c, c + 4)]) for c in range(6)], "claim long, ct array<string>")
    run = lambda: sorted(map(tuple, C.best_paragraphs(claims, spark.createDataFrame(rows, "doc_id long, place int, pt array<string>")).collect()))
    want = run()
    monkeypatch.setattr(C, "SENT_ROWS", 0)
    assert run() == want and len(want) == 18


def test_documents_are_cut_into_words_once(spark, monkeypatch):
    docs = spark.range(9).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 7, F.concat(F.lit("red red w"), F.col("id") % 3, F.lit(" end"))).when(F.col("id") == 7, "").alias("text"))
    asked = spark.createDataFrame([(1, "red"), (1, "red"), (1, "w1"), (2, "w2"), (2, "never")], "item_id long, term string")
    toks = F.filter(F.split("text", " "), lambda w: w != "")
    want = {tuple(r) for r in R.bm25(R.postings(docs, "doc_id", toks), R.collection(docs, toks), asked, "doc_id", "item_id").select("item_id", "doc_id", "score").collect()}
    for most in (R.SENT_TERMS, 0):
        monkeypatch.setattr(R, "SENT_TERMS", most)
        out = R.scored(docs, "doc_id", toks, asked, "item_id")
        assert "Range (" not in _plan(out)
        # no exchange between a document's counts and its scores
        assert ("hashpartitioning(item_id" in out._jdf.queryExecution().executedPlan().toString()) == (not most)
        assert {tuple(r) for r in out.select("item_id", "doc_id", "score").collect()} == want and len(want) == 9
    assert R.scored(docs.where("false"), "doc_id", toks, asked, "item_id").count() == 0
