"""Sum-of-squares online packing of token sequences into fixed windows.

A level array counts the partly filled windows at each fill. A piece goes to the level where the
sum of the squared counts grows least (a new window is level nought), the fuller one on ties. Each
task packs its own documents in order; the windows it leaves partly filled are then packed once
more, whole, in groups drawn over many tasks, by the same rule.

Defined cases: a null text counts as empty, and like an empty one is the closing id alone; a document
longer than a window is cut into full windows and a rest; repeated rows are packed each for itself;
an empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.bpe import encoder
from lakequill.llm.common import checkpointed

WINDOW = 2048
#: Windows that one group of the second packing aims at.
GROUP_WINDOWS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, fill long"


class LevelPacker:
    """Online packing into windows of ``size`` by least growth of the sum of squared level counts."""

    def __init__(self, size: int) -> None:
        self.size, self.windows = size, 0
        self.leave = np.full(size + 1, np.int64(2**40))  # growth by a window leaving this level
        self.reach = np.ones(size + 1, np.int64)  # growth by a window reaching it
        self.reach[size] = 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _count(self, level: int, by: int) -> None:
        if 0 < level < self.size:
            self.reach[level] += 2 * by
            n = (int(self.reach[level]) - 1) // 2
            self.leave[level] = 1 - 2 * n if n else 2**40

    def place(self, length: int) -> tuple[int, int]:
        """The window for a piece, and the fill at which it starts there."""
        top = self.size - length
        growth = self.leave[1 : top + 1] + self.reach[length + 1 :]
        level = 0
        if top > 0:
            k = top - 1 - int(growth[::-1].argmin())
            if growth[k] <= self.reach[length]:
                level = k + 1
        if level:
            window = self.at[level].pop()
            self._count(level, -1)
        else:
            window, self.windows = self.windows, self.windows + 1
        if level + length < self.size:
            self.at[level + length].append(window)
            self._count(level + length, 1)
        return window, level

    def fills(self) -> dict[int, int]:
        return {w: level for level, ws in enumerate(self.at) for w in ws}


def pack_ids(path: str, end_id: int, window: int):
    """The per-task packer over Arrow batches of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, end = encoder(path), LevelPacker(window), end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 32
        open_rows: dict[int, list[tuple]] = {}
        out: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

        for b in batches:
            keys = b.column(0).to_pylist()
            for key, ids in zip(keys, bpe.encode_many([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    n = len(part) // 4
                    w, at = packer.place(n)
                    row = (key, start, n, zlib.crc32(part), total, base | w, at)
                    if at + n == window:
                        out += [(*r, window) for r in [*open_rows.pop(w, []), row]]
                    else:
                        open_rows.setdefault(w, []).append(row)
            if len(out) >= 20_000:
                yield flush(out)
                out = []
        for rows in open_rows.values():
            fill = rows[-1][6] + rows[-1][2]
            out += [(*r, fill) for r in rows]
        if out:
            yield flush(out)

    return run


def _regroup(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        packer, seen = LevelPacker(window), {}
        pdf = pdf.sort_values(["fill", "window"], ascending=[False, True])
        rows = []
        for w, fill in zip(pdf.window.tolist(), pdf.fill.tolist(), strict=True):
            k, at = packer.place(fill)
            rows.append((w, seen.setdefault(k, w), at))
        return pd.DataFrame(rows, columns=["window", "sequence_id", "base"])

    return run


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The only shuffles are of rows of a few numbers each: the open windows, and the pieces on their
    window. The first packing is checkpointed, so both uses of it see the same windows whatever is lost.
    """
    pieces = checkpointed(docs.select("doc_id", "text").mapInArrow(pack_ids(path, end_id, window), PIECES))
    opened = pieces.where(F.col("fill") < window).groupBy("window").agg(F.max("fill").alias("fill"))
    opened = checkpointed(opened)
    groups = max(1, -(-opened.count() // GROUP_WINDOWS))
    moved = (
        opened.withColumn("g", F.pmod(F.shiftright("window", 32), F.lit(groups)))
        .groupBy("g")
        .applyInPandas(_regroup(window), "window long, sequence_id long, base long")
    )
    return pieces.join(moved, "window", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("sequence_id", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
