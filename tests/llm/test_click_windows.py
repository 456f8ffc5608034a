"""Click windows against a plain fold over the same batches."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest

from lakequill.llm import click_windows

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, page string, n string, batch int"
START = datetime(2024, 1, 1)


def _micros(t):
    return (t.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def _windows(rows):
    text = lambda x: "" if x is None else str(x)
    copies = []
    for click, ts, at, client, kind, value, props, *_ in rows:
        if click is None or at is None:
            continue
        for j in range(click % 3 + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = _micros(at) // 3_600_000_000 + 6 * j * (c % 10)
            cents = None if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
            fields = [text(client), text(kind), text(cents), text(None if ts is None else _micros(ts)), text(props), str(c % 3)]
            copies.append((hour + c // 10 % 200, click, hour, hashlib.sha256("|".join(fields).encode()).hexdigest()))
    lo, hi = min(c[0] for c in copies), max(c[0] for c in copies)
    batches = defaultdict(list)
    for late, *row in copies:
        batches[(late - lo) * 10 // (hi - lo + 1)].append(tuple(row))
    known, open_, out = None, {}, []
    for b in range(10):
        for click, hour, digest in sorted(r for r in batches[b] if known is None or r[1] >= known - 24):
            w = open_.get(click)
            if w is None or hour > w[0] + 48:
                if w:
                    out.append((click, w[0], b, *w[2:], w[1]))
                open_[click] = [hour, digest, 0, 0, 0]
            else:
                w[2] += 1
                if digest != w[1]:
                    w[3] += 1
                    w[4] += zlib.crc32(digest.encode())
        known = max([r[1] for r in batches[b]] + ([known] if known is not None else []), default=None)
        for click in [k for k, w in open_.items() if known is not None and w[0] + 48 < known - 24]:
            w = open_.pop(click)
            out.append((click, w[0], b, *w[2:], w[1]))
    return sorted(out + [(k, w[0], 9, *w[2:], w[1]) for k, w in open_.items()])


def _rows(n):
    rng = random.Random(2)
    rows = []
    for _ in range(n):
        click = rng.randint(0, 40)
        at = START + timedelta(hours=rng.randint(0, 700), microseconds=rng.randint(0, 10**9))
        value = rng.choice([None, 0.005, 1.25, -3.0, float("nan"), float("inf"), 7.0])
        rows.append((click, rng.choice([None, at - timedelta(minutes=5)]), at, rng.choice([None, 1, 2]), rng.choice([None, "a|b"]), value, rng.choice([None, '{"k": 1}']), "p", "x", 3))
    rows += rows[:10] * 2  # the same rows again
    rows += [(None, START, START, 1, "a", 1.0, None, "p", "x", 3), (5, START, None, 1, "a", 1.0, None, "p", "x", 3)]
    rows += [(7, START, START + timedelta(hours=3), 1, "hot", 1.0, "x" * 100_000, "p", "x", 3)] * 300  # one click in very many copies
    return rows


@pytest.mark.parametrize("ids_per_key", [1, 7])
def test_against_a_plain_fold(spark, ids_per_key):
    rows = _rows(250)
    want = _windows(rows)
    got = click_windows.windows(spark.createDataFrame(rows, SCHEMA), ids_per_key=ids_per_key)
    assert got.dtypes[:6] == [(c, "bigint") for c in "click_id start_hour closed_batch n_repeats n_conflicts conflict_crc".split()]
    assert sorted(map(tuple, got.collect())) == want
    assert len({w[2] for w in want}) > 5 and any(w[4] for w in want) and max(w[3] for w in want) >= 299


def test_empty(spark):
    assert click_windows.windows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"  # settings are put back


def test_session_zone_plays_no_part(spark):
    rows = _rows(30)[:30]
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = click_windows.windows(spark.createDataFrame(rows, SCHEMA))
        assert sorted(map(tuple, got.collect())) == _windows(rows)
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_a_page_is_one_value_and_stores_do_not_stay():
    import pyarrow as pa

    assert [c.split()[1] for c in click_windows.STATE.split(", ")] == ["binary", "long"]  # no array to convert number by number
    assert click_windows._SETTINGS["spark.sql.streaming.stateStore.unloadOnCommit"] == "true"
    rows = [(7, -3, 2, 5, 1, 2**40, bytes(range(32))), (-1, 4, 0, 0, 0, 0, b"\0" * 32)]
    packed = pa.RecordBatch.from_pydict({"closed": [b"".join(click_windows.CLOSED.pack(*r) for r in rows), b""]})
    (got,) = click_windows.unpacked([packed])
    assert [tuple(r.values()) for r in got.to_pylist()] == rows
