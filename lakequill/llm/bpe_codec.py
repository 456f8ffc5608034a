"""BPE encoding and decoding of a text column (contiguous rank array, see :mod:`lakequill.llm.bpe`).

Defined cases: a null text counts as empty and gives no ids; texts of any length are encoded whole;
repeated rows give repeated results; an empty table gives an empty result of the same schema; other
columns of the input are neither read nor returned, so clashing names do no harm. A null key is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lakequill.llm.bpe import encoder


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def map_codec(docs: DataFrame, path: str, derive: Callable[[bytes, str], tuple], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``derive(ids as little-endian 32-bit bytes, decoded text)`` for every row; ``schema`` names the key and what it returns.

    One narrow pass without a shuffle: a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            if not b.num_rows:
                continue
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [derive(ids, bpe.decode(ids)) for ids in bpe.encode_many(texts)]
            cols = [b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names=list(names))

    names, types = zip(*(c.split() for c in schema.split(",")), strict=True)
    kinds = [_ARROW[t] for t in types[1:]]
    return docs.select(key, text).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)``."""
    import numpy as np

    return map_codec(docs, path, lambda ids, _: (np.frombuffer(ids, "<i4").tolist(),), f"{key} long, ids array<int>", key, text)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` from an array of ids; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = encoder(path)
        for b in batches:
            out = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return tokens.select(key, ids).mapInArrow(run, f"{key} long, text string")


def digest(ids: bytes, decoded: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()
