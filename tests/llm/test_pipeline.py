import pytest

from lakequill.llm import stages

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "packing"]
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in out.select("doc_id").collect()}
        out = stage(spark, out, DIR)
        assert out.columns == docs.columns and {r["doc_id"] for r in out.select("doc_id").collect()} <= before
    assert stages.drop_copies(spark, docs.unionByName(docs.selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")), DIR).where("doc_id >= 100000").count() == 0


def test_pack_covers_every_document(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, ""), (3, None), (4, "word " * 5000)], "doc_id long, text string")
    by = {}
    for r in stages.pack(spark, docs, DIR).collect():
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(by) == {1, 2, 3, 4} and by[2] == by[3] == [(0, 1, 1)]
    for pieces in by.values():
        assert sum(n for _, n, _ in pieces) == pieces[0][2]
        at = 0
        for start, n, _ in sorted(pieces):
            assert start == at
            at += n
