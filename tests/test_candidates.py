"""The ledger of references against a loop over all events in order, fed in any order and more than once."""

import random

import pytest

from lakequill.operators import candidates as C
from lakequill.streaming import candidates as S

MENTION, DECISION = "key long, source long, first_at long, last_at long", "key long, at long, seq long, what string"


def _events():
    rng = random.Random(11)
    mentions = [(rng.randrange(12), rng.randrange(6), t) for t in (rng.randrange(100) for _ in range(90))]
    decisions = [(rng.randrange(14), rng.randrange(100), i, rng.choice([C.MARK, C.REJECT, C.REJECT, C.REOPEN, C.REOPEN, "look"])) for i in range(120)]
    return mentions, decisions


def _loop(mentions, decisions, index):
    seen, state = {}, {}
    steps = sorted([(t, -1, "mention", k, s) for k, s, t in mentions] + [(t, n, w, k, None) for k, t, n, w in decisions])
    for t, _, what, k, s in steps:
        if what == "mention":
            first, last, sources = seen.get(k, (t, t, set()))
            seen[k] = (min(first, t), max(last, t), sources | {s})
            state.setdefault(k, ("pending", None))
        elif k in state:
            if what in (C.MARK, C.REJECT):
                state[k] = ("ingested" if what == C.MARK else "rejected", t)
            elif what == C.REOPEN and state[k][0] == "rejected":
                state[k] = ("pending", None)
    out = {}
    for k, (first, last, sources) in seen.items():
        s, at = state[k]
        if s == "pending" and k in index:
            s, at = "ingested", last
        out[k] = (len(sources), s, first, last, at)
    return out


@pytest.fixture(scope="module")
def data(spark):
    mentions, decisions = _events()
    m = spark.createDataFrame([(k, s, t, t) for k, s, t in mentions] + [(None, 1, 1, 1), (3, None, 1, 1), (3, 77, None, 1)], MENTION)
    d = C.decided(spark.createDataFrame([*decisions, (None, 1, 1, C.MARK), (1, None, 1, C.MARK)], DECISION))
    index = spark.createDataFrame([(0,), (1,), (1,), (99,), (None,)], "key long")
    return m, d, index, _loop(mentions, decisions, {0, 1})


def _states(m, d, index):
    return {r.key: (r.demand, r.state, r.first_seen, r.last_seen, r.resolved_at) for r in C.ledger(C.fold_mentions(m), C.fold_decisions(d), index).collect()}


def test_ledger(data):
    m, d, index, want = data
    assert _states(m, d, index) == want
    assert {s for _, s, *_ in want.values()} == {"pending", "ingested", "rejected"}
    assert _states(m.where("false"), d, index) == {}
    assert {k: (v[1], v[4]) for k, v in _states(m, d.where("false"), index).items() if k > 1} == {k: ("pending", None) for k in want if k > 1}


def test_streams_in_any_order(spark, data, tmp_path):
    m, d, index, want = data
    for name, rows, schema, fold in (("m", m, m.schema, C.fold_mentions), ("d", d, d.schema, C.fold_decisions)):
        for seed in (3, 1, 2, 3):  # the rows in pieces of no order, one piece twice
            rows.sample(0.5, seed).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{name}")
        rows.coalesce(2).write.mode("append").parquet(f"{tmp_path}/in-{name}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in-{name}")
        S.follow(stream, fold, f"{tmp_path}/{name}", f"{tmp_path}/c-{name}").awaitTermination()
        S.compact(spark, f"{tmp_path}/{name}", f"{tmp_path}/{name}2", fold)
    for n in ("", "2"):
        got = _states(S.kept(spark, f"{tmp_path}/m{n}", C.fold_mentions), S.kept(spark, f"{tmp_path}/d{n}", C.fold_decisions), index)
        assert got == want
