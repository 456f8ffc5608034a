"""Claim audit against plain loops."""

import math
import random


from lakequill.operators import claims as C


def test_tokens_and_dumps(spark):
    rows = [("Héllo WORLD-2.5% a",), ("学習率 を x 上",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(C.audit_tokens("t")).collect()]
    assert got == [["h", "llo", "world-2.5%", "a"], ["x", "学習", "習率"], [], None]
    texts = ["1 2 3 4 5 6 7", "one two three four five 6 7 8", "one two three four five six 7", "short one"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.table_dump("t")).collect()] == [True, True, False, True]


def test_paragraphs_split_at_empty_lines(spark):
    text = "one two three four five six seven\n  continued line\n \ntoo short\n\n1 2 3 4 5 6 7 8 9 10 11 12 13\n\na b c d e f g h i j k l"
    got = C.paragraphs(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t").collect()
    assert [(r.id, r.place, r.body) for r in got] == [(1, 0, "one two three four five six seven continued line"), (1, 3, "a b c d e f g h i j k l")]


def test_best_paragraphs_are_exact(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    some = lambda n: sorted(set(rng.choices(words, weights, k=n)))
    paras = [(d, p, some(rng.randint(1, 40))) for d in range(40) for p in range(5)]
    claims = [(c, some(rng.randint(1, 15))) for c in range(25)] + [(98, []), (99, ["unheard"]), (97, ["w59", "w58"])]
    want = set()
    for c, ct in claims:
        hit = [(-len(set(ct) & set(pt)) / math.sqrt(len(pt)), d, p) for d, p, pt in paras if set(ct) & set(pt)]
        want |= {(c, d, p, k + 1) for k, (_, d, p) in enumerate(sorted(hit)[:3])}
    got = C.best_paragraphs(spark.createDataFrame(claims, "claim long, ct array<string>"), spark.createDataFrame(paras, "doc_id long, place int, pt array<string>"))
    assert {(r.claim, r.doc_id, r.place, r.rank) for r in got.collect()} == want


def test_one_sided(spark):
    callouts = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "A"), (5, "D")], "id long, host string")
    mentions = spark.createDataFrame(
        [(1, "B", False), (1, "S1", True), (2, "C", False), (3, "X", False), (3, "S1", True), (4, "C", False), (4, "D", False), (5, "A", False), (1, "E", False)],
        "id long, name string, is_source boolean",
    )
    parties = spark.createDataFrame([(n, "concept") for n in "ABCDE"], "party string, party_type string")
    got = {(r.id, r.host, r.party) for r in C.one_sided(callouts, mentions, parties).collect()}
    # B names no A and shares nothing with callout 1; C shares nothing with callout 4; D names A back; E has no callout
    assert got == {(1, "A", "B"), (1, "A", "E"), (4, "A", "C"), (2, "B", "C")}
    assert C.one_sided(callouts.where("false"), mentions, parties).count() == 0
