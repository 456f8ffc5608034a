"""Expiring de-duplication of clicks with ``transformWithStateInPandas`` on RocksDB.

A click opens a window of ``SPAN`` hours; arrivals of the same click up to its end are repeats, counted
into the window; a later one closes it and opens another. Windows whose end lies behind the watermark
close by an event-time timer. The stream is fed batch by batch, each by a query started anew on one
checkpoint, so that what is known of open windows lies in the state store alone.

* State: the open window of a click (opener's hour and hash, repeats, conflicts, sum of the conflicts' checksums).
  A grouping key is a page of ``ids_per_key`` ids side by side, and its ValueState the open windows of that
  page, one an id: the calls between Python and the state store cost more than the fold of a click, and a page
  shares them. ``ids_per_key`` = 1 gives a key for each click and the same rows.
* The windows of a page are one binary value of ``WINDOW`` records, in the state as in the result of a micro-batch, since
  each column of a page's result and each number of its state would be converted for itself. The result is read apart by array operations.
* Late arrivals are dropped by the watermark: hours are whole, so it trails by ``LATE`` hours and a half.
* Timers stand a quarter of an hour behind the last hour of a window, so that a timer and the watermark never tie.
* Micro-batches without data are off, as each costs a start of all state tasks: what the watermark after a batch makes
  due is closed at the beginning of the next one, page by page before new rows or by the timer, and counts to the batch before.
* Each start runs one micro-batch, so that a task closes its store when it has committed it; else the stores of the
  starts before would stay in memory until maintenance finds them.
* A last input row far ahead in time moves the watermark behind all timers; a micro-batch without data then flushes the windows left.

Equal arrivals (id, hour and hash) are counted before the stream, so that a click that comes in very many
copies is a few rows. The rows go to files under ``spark.checkpoint.dir``, and results to a file sink,
whose log makes each micro-batch count once, however often a lost task or a failed run repeats it.

Defined cases: a row without ``click_id`` or ``arrived_at`` has no copies; null fields are empty in the
hash, as is a value that is no finite number; equal rows are copies each for itself; a batch without rows closes nothing; an empty table
gives an empty result; other columns are not read. Time zones of the session play no part.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakequill.llm.common import checkpoint_folder

SPAN, LATE, BATCHES = 48, 24, 10
IDS_PER_KEY = 256
HOUR_MS = 3_600_000
FED = "click_id long, seen timestamp, hash binary, n long, page long"
STATE = "windows binary, timer long"
OUT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"
#: click_id, start_hour, n_repeats, n_conflicts, conflict_crc and hash of a window; of a closed one with closed_batch after start_hour.
WINDOW, CLOSED = struct.Struct("<5q32s"), struct.Struct("<6q32s")
PACKED = "closed binary"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
_SETTINGS = {
    _NO_DATA: "false",
    "spark.sql.session.timeZone": "UTC",  # hours are read off timestamps that Python gets in the session's zone
    "spark.sql.streaming.statefulOperator.allowMultiple": "false",  # with one stateful operator, late rows are told by the latest watermark
    "spark.sql.streaming.stateStore.providerClass": _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store takes megabytes of disk before it holds a row
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # folders of the starts before are deleted
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, one without a zone being taken as UTC."""
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.unix_micros(name)
    gap = F.col(name) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    part = lambda what: F.extract(F.lit(what), gap).cast("decimal(20,6)")
    return (part("DAY") * 86_400_000_000 + part("HOUR") * 3_600_000_000 + part("MINUTE") * 60_000_000 + part("SECOND") * 1_000_000).cast("long")


def copies(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``(click_id, hour, hash binary, n, batch)``: the arrivals of all clicks, equal ones of a batch counted."""
    micros = epoch_micros(clicks, "arrived_at")
    cents = F.when(F.abs("value") < 1e300, F.floor(F.col("value") * 100 + 0.5).cast("string"))
    row = clicks.where("click_id is not null and arrived_at is not null").select(
        "click_id",
        ((micros - F.pmod(micros, F.lit(3_600_000_000))) / 3_600_000_000).cast("long").alias("h0"),
        *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in (("c1", F.col("client_id")), ("c2", F.col("kind")), ("c3", cents), ("c4", epoch_micros(clicks, "ts")), ("c5", F.col("props")))),
    )
    each = row.withColumn("j", F.explode(F.when(F.col("click_id") % 3 >= 0, F.sequence(F.lit(0), (F.col("click_id") % 3).cast("int"))).otherwise(F.array().cast("array<int>"))))
    each = each.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary")))
    each = each.withColumn("hour", F.col("h0") + 6 * F.col("j") * (F.col("c") % 10))
    each = each.withColumn("l", F.col("hour") + F.expr("c div 10") % 200)
    lo, hi = each.agg(F.min("l"), F.max("l")).first()
    if lo is None:
        lo = hi = 0
    digest = F.sha2(F.concat_ws("|", "c1", "c2", "c3", "c4", "c5", (F.col("c") % 3).cast("string")), 256)
    out = each.select("click_id", "hour", digest.alias("hex"), ((F.col("l") - lo) * batches).alias("over"))
    out = out.select("click_id", "hour", F.unhex("hex").alias("hash"), F.expr(f"over div {hi - lo + 1}").cast("int").alias("batch"))
    return out.groupBy("batch", "click_id", "hour", "hash").agg(F.count("*").alias("n"))


class ClickWindows(StatefulProcessor):
    """Folds the arrivals of a page of clicks into their open windows, and closes windows by timers.

    ``batch`` is the number of the batch that is folded, ``before`` that of the batch whose watermark is due now.
    """

    def __init__(self, batch: int, before: int, span: int = SPAN) -> None:
        self.batch, self.before, self.span = batch, before, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def close(self) -> None:
        pass

    def _expiry(self, start: int) -> int:
        return (start + self.span) * HOUR_MS + HOUR_MS // 4

    def _load(self) -> tuple[dict[int, list], int | None]:
        """``{click_id: [start_hour, n_repeats, n_conflicts, conflict_crc, hash]}``, and the timer that stands."""
        held = self.open.get()
        if held is None:
            return {}, None
        return {k: w for k, *w in WINDOW.iter_unpack(held[0])}, held[1]

    def _save(self, windows: dict[int, list], timer: int | None) -> None:
        """Writes the windows left and sees that one timer stands at the first one's expiry."""
        first = self._expiry(min(w[0] for w in windows.values())) if windows else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if windows:
            self.open.update((b"".join([WINDOW.pack(k, *w) for k, w in windows.items()]), first))
        else:
            self.open.clear()

    def _due(self, windows: dict[int, list], watermark: int) -> list[bytes]:
        """Takes out the windows that end before the watermark."""
        ids = [k for k, w in windows.items() if self._expiry(w[0]) <= watermark]
        return [self._closed(k, self.before, windows.pop(k)) for k in ids]

    @staticmethod
    def _closed(click: int, batch: int, w: list) -> bytes:
        return CLOSED.pack(click, w[0], batch, *w[1:])

    @staticmethod
    def _rows(closed: list[bytes]) -> Iterator[pd.DataFrame]:
        if closed:
            yield pd.DataFrame({"closed": [b"".join(closed)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = [t for part in rows for t in zip(part.click_id.tolist(), (part.seen.astype("datetime64[ms]").astype("int64") // HOUR_MS).tolist(), map(bytes, part.hash.tolist()), part.n.tolist(), strict=True) if t[3]]
        if not come:  # only the row that flushes
            return
        come.sort()
        windows, timer = self._load()
        closed = self._due(windows, timerValues.getCurrentWatermarkInMs())
        for click, hour, digest, n in come:
            w = windows.get(click)
            if w is None or hour > w[0] + self.span:
                if w is not None:
                    closed.append(self._closed(click, self.batch, w))
                windows[click] = [hour, n - 1, 0, 0, digest]
            else:
                w[1] += n
                if w[4] != digest:
                    w[2] += n
                    w[3] += n * crc32(digest.hex().encode())
        self._save(windows, timer)
        yield from self._rows(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        windows, _ = self._load()
        closed = self._due(windows, timerValues.getCurrentWatermarkInMs())
        self._save(windows, None)  # the timer that fired is gone by itself
        yield from self._rows(closed)


def feed(spark: SparkSession, folder: str, batch: int, before: int) -> None:
    """One start of the query: reads what is new in ``folder/in``, closes what is due, and ends."""
    rows = spark.readStream.schema(FED).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    done = (
        rows.withWatermark("seen", f"{60 * LATE + 30} minutes")
        .groupBy("page")
        .transformWithStateInPandas(ClickWindows(batch, before), PACKED, "Append", "EventTime")
    )
    q = done.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/query").trigger(availableNow=True).start()
    q.awaitTermination()


_CLOSED = np.dtype([(c.split()[0], "<i8") for c in OUT.split(", ")[:-1]] + [("hash", "V32")])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The closed windows as rows, the hash still binary."""
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), _CLOSED)
        digests = pa.Array.from_buffers(pa.binary(32), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows["hash"]))]).cast(pa.binary())
        longs = [pa.array(np.ascontiguousarray(rows[c])) for c in _CLOSED.names[:-1]]
        yield pa.RecordBatch.from_arrays([*longs, digests], names=list(_CLOSED.names))


def windows(clicks: DataFrame, batches: int = BATCHES, ids_per_key: int = IDS_PER_KEY) -> DataFrame:
    """``(click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash)`` of every window of every click."""
    spark = clicks.sparkSession
    folder = f"{checkpoint_folder(spark)}/clicks-{uuid.uuid4().hex}"
    fed = copies(clicks, batches).select(
        "click_id", F.timestamp_seconds(F.col("hour") * 3600).alias("seen"), "hash", "n", F.floor(F.col("click_id") / ids_per_key).alias("page"), "batch"
    )
    fed.write.partitionBy("batch").parquet(f"{folder}/cut")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    fs.mkdirs(path(f"{folder}/in"))
    was = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        before = 0
        for b in range(batches):
            if fs.exists(path(f"{folder}/cut/batch={b}")):
                fs.rename(path(f"{folder}/cut/batch={b}"), path(f"{folder}/in/part-{b}"))
                feed(spark, folder, b, before)
                before = b
        last = spark.read.schema(FED).option("recursiveFileLookup", "true").parquet(f"{folder}/in").agg(F.max("seen").alias("seen")).where("seen is not null")
        flush = last.count() > 0
        if flush:
            far = F.col("seen") + F.expr(f"INTERVAL {SPAN + 2 * LATE} HOURS")
            ahead = last.select(F.lit(-1).cast("long").alias("click_id"), far.alias("seen"), F.lit(b"").alias("hash"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("page"))
            ahead.coalesce(1).write.parquet(f"{folder}/in/part-{batches}")
            spark.conf.set(_NO_DATA, "true")
            feed(spark, folder, batches, batches - 1)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not flush:
        return spark.createDataFrame([], OUT)
    closed = spark.read.schema(PACKED).parquet(f"{folder}/out").mapInArrow(unpacked, OUT.replace("hash string", "hash binary"))
    return closed.withColumn("hash", F.lower(F.hex("hash")))
