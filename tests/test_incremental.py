"""Indexes fed by batches against one full build; replays; what a batch touches."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.streaming.incremental import TermIndex, VectorTable, refresh

SCHEMA = "doc_id long, text string, deleted boolean, seq long"
BATCHES = [
    [(1, "red fox runs", False, 0), (2, "blue whale", False, 0), (3, None, False, 0), (1, "red fox sits", False, 1)],
    [(1, "red fox sits", False, 2), (2, "blue whale sings red songs", False, 2), (4, "red red red", False, 2)],
    [(4, None, True, 3), (9, None, True, 3), (2, "blue whale sings red songs", False, 3)],
    [],
    [(4, "red again", False, 5), (5, "", False, 5), (1, "gone soon", False, 5), (1, None, True, 6)],
]


def _want(n):
    now = {}
    for b in BATCHES[:n]:
        for key, text, deleted, _ in sorted(b, key=lambda r: r[3]):
            now.pop(key, None) if deleted else now.update({key: text or ""})
    return now


def _got(index):
    return sorted((r.term, r.doc_id, r.tf, r.dl) for r in index.postings().collect())


def _full(pages):
    out = []
    for key, text in pages.items():
        ts = [w for w in text.split() if len(w) > 1]
        out += [(w, key, n, len(ts)) for w, n in Counter(ts).items()]
    return sorted(out)


def test_batches_give_the_full_build_and_replays_change_nothing(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path), T.latin_tokens, buckets=5, parts=3)
    assert _got(index) == []
    for v, rows in enumerate(BATCHES):
        batch = spark.createDataFrame(rows, SCHEMA)
        index.apply(batch, v)
        want = _full(_want(v + 1))
        assert _got(index) == want
        index.apply(batch, v)  # the same micro-batch again
        assert _got(index) == want
        stats = index.collection().first()
        assert stats["n_docs"] == len(_want(v + 1))
    for v, rows in enumerate(BATCHES[:2]):  # late replays of old ones, too
        index.apply(spark.createDataFrame(rows, SCHEMA), v)
    assert _got(index) == _full(_want(len(BATCHES)))


def test_a_batch_touches_the_buckets_of_its_terms_only(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path), T.latin_tokens, buckets=50, parts=3)
    for v, rows in enumerate(BATCHES[:2]):
        index.apply(spark.createDataFrame(rows, SCHEMA), v)
    words = spark.createDataFrame([(w,) for w in "blue whale sings red songs".split()], "term string")
    own = {r[0] for r in words.select(F.pmod(F.hash("term"), F.lit(50))).collect()}
    touched = {int(p.name.split("=")[1]) for p in Path(tmp_path, "postings", "version=1").glob("bucket=*")}
    assert touched == own  # page 1 came unchanged, so "fox" and "sits" are not written again
    index.apply(spark.createDataFrame(BATCHES[1], SCHEMA), 2)
    assert not Path(tmp_path, "postings", "version=2").exists()


def test_scores_prune_buckets(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path), T.latin_tokens, buckets=50, parts=3)
    for v, rows in enumerate(BATCHES):
        index.apply(spark.createDataFrame(rows, SCHEMA), v)
    asked = spark.createDataFrame([("q", "red"), ("q", "red"), ("q", "nothing")], "query string, term string")
    assert {r.doc_id for r in index.bm25(asked, "query").collect()} == {2, 4}
    plan = index.postings(asked.select("term"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]


def test_vectors_are_made_once_for_a_text(spark, tmp_path):
    asked = []

    def embed(pages):
        asked.append(sorted(r.doc_id for r in pages.collect()))
        return pages.where("text <> ''").select("doc_id", F.array(F.length("text").cast("double")).alias("vec"))

    table = VectorTable(spark, str(tmp_path), embed, parts=2)
    for v, rows in enumerate(BATCHES):
        table.apply(spark.createDataFrame(rows, SCHEMA), v)
    assert asked == [[1, 2, 3], [2, 4], [], [4, 5]]
    got = {r.doc_id: r.vec for r in table.vectors().collect()}
    assert got == {2: [26.0], 3: None, 4: [9.0], 5: None}
    assert {r.doc_id: r.made for r in table.history().collect()} == {2: 2, 3: 1, 4: 2, 5: 1}


@pytest.mark.parametrize("starts", [1, 3])
def test_streamed(spark, tmp_path, starts):
    index = TermIndex(spark, f"{tmp_path}/index", T.latin_tokens, buckets=4, parts=2)
    for s in range(starts):
        rows = [r for b in BATCHES[s * len(BATCHES) // starts : (s + 1) * len(BATCHES) // starts] for r in b]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{s}")
        refresh(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/query", index)
    assert _got(index) == _full(_want(len(BATCHES)))
