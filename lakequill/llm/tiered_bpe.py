"""Byte-level BPE by a two-tier lookup, for vocabularies given as ranks of byte strings.

First tier: a minimal perfect hash over the vocabulary, which resolves every pre-token that is itself a
vocabulary entry with one hash and one comparison. Second tier: pre-tokens that are no entry are merged
over a linked list of byte parts, with a heap of the adjacent pairs by rank and place. Both tiers see
only distinct pre-tokens of a batch; a bounded cache keeps the ids of those met before.

Defined cases: a null text counts as empty and gives no ids; texts of any length are encoded whole, a
pre-token of any length in n log n steps; repeated rows give repeated results; an empty table gives an
empty result of the same schema; other columns are neither read nor returned, so clashing names do no
harm; a null key is kept. Null or empty id arrays decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

_BATCH_CHARS = 1_000_000
#: Pre-tokens of a generation of the cache, and the bytes of the longest that is kept: together they bound its memory.
CACHE_WORDS, CACHE_LENGTH = 400_000, 64
_U = np.uint64


class PerfectHash:
    """Minimal perfect hash by displacement: ``n`` keys stand in exactly ``n`` slots.

    Keys fall into buckets by their hash. Larger buckets first, each gets the least displacement that
    sends all its keys to free slots; a bucket of one key stores its slot outright.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        h = self._hashes(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("two keys are equal or share a hash")
        self.displaced = np.zeros(self.buckets, np.int64)
        at = (h % _U(self.buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        taken, slot_of = np.zeros(self.n, bool), np.empty(self.n, np.int64)
        single = []
        for b in np.argsort(-sizes, kind="stable").tolist():
            if not sizes[b]:
                break
            mine = order[edges[b] : edges[b + 1]]
            if len(mine) == 1:
                single.append((b, mine[0]))
                continue
            first, step = 0, 32
            while True:
                tried = self._mix(h[mine][:, None], np.arange(first, first + step, dtype=_U)[None, :])
                ordered = np.sort(tried, 0)
                good = np.flatnonzero(~taken[tried].any(0) & (ordered[1:] != ordered[:-1]).all(0))
                if len(good):
                    self.displaced[b] = first + good[0]
                    slot_of[mine] = tried[:, good[0]]
                    taken[tried[:, good[0]]] = True
                    break
                first, step = first + step, min(step * 2, 4096)
        for (b, k), free in zip(single, np.flatnonzero(~taken).tolist(), strict=True):
            self.displaced[b], slot_of[k] = -free - 1, free
        self.key_in: list[bytes] = [b""] * self.n
        for s, k in zip(slot_of.tolist(), keys, strict=True):
            self.key_in[s] = k
        self.slot_of = slot_of

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), _U, len(keys))

    def _mix(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = h ^ (d + _U(1)) * _U(0x9E3779B97F4A7C15)
        x = (x ^ x >> _U(31)) * _U(0xD6E8FEB86659FD93)
        return ((x ^ x >> _U(32)) % _U(self.n)).astype(np.int64)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """The slot of each word, -1 for what is no key."""
        h = self._hashes(words)
        d = self.displaced[(h % _U(self.buckets)).astype(np.int64)]
        s = np.where(d < 0, -d - 1, self._mix(h, np.maximum(d, 0).astype(_U)))
        same = np.fromiter((self.key_in[i] == w for i, w in zip(s.tolist(), words, strict=True)), bool, len(words))
        return np.where(same, s, -1)


class TieredBPE:
    """Encoder and decoder over ``{bytes: rank}``; a rank is the id of its bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.longest = max(map(len, ranks))
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.id_in = np.empty(len(keys), "<u4")
        self.id_in[self.hash.slot_of] = np.fromiter(ranks.values(), "<u4", len(keys))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)])
        self.pair_rank = np.full(65536, -1)
        for b, i in ranks.items():
            if len(b) == 2:
                self.pair_rank[b[0] << 8 | b[1]] = i
        self.piece = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.piece[i] = b
        self.cache: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    def _merge(self, word: bytes, ids: list[int], pairs: list[int]) -> list[int]:
        """Second tier: the pair of least rank merges first, the leftmost of equal ones, until none has a rank.

        A part is known by where it starts. Heap entries are whole numbers: rank, start and end of the pair,
        in this order. ``ids`` and ``pairs`` are the ids of the bytes and the ranks of bytes side by side, -1 for none.
        """
        n, get, longest = len(word), self.ranks.get, self.longest
        bits = (n + 1).bit_length()
        mask = (1 << bits) - 1
        nxt, prev = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r << bits | i) << bits | i + 2 for i, r in enumerate(pairs) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            end, i = top & mask, top >> bits & mask
            j = nxt[i]
            if j >= n or nxt[j] != end:  # one of the two has been merged since; a dead part has its next set beyond the end
                continue
            nxt[i], nxt[j], ids[i] = end, n + 1, top >> bits + bits
            if end < n:
                prev[end] = i
                after = nxt[end]
                if after - i <= longest and (r := get(word[i:after])) is not None:
                    heappush(heap, (r << bits | i) << bits | after)
            before = prev[i]
            if before >= 0 and end - before <= longest and (r := get(word[before:end])) is not None:
                heappush(heap, (r << bits | before) << bits | end)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = nxt[i]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each non-empty pre-token, as little-endian 32-bit integers."""
        raw = [w.encode() for w in words]
        slots = self.hash.slots(raw)
        whole = self.id_in[np.maximum(slots, 0)].tobytes()
        out = [whole[4 * k : 4 * k + 4] for k in range(len(raw))]
        missed, ids, edge, lo = np.flatnonzero(slots < 0).tolist(), [], [0], 0
        flat = np.frombuffer(b"".join([raw[k] for k in missed]) + b"\0", np.uint8)
        first, pairs = self.byte_id[flat].tolist(), self.pair_rank[flat[:-1].astype(np.int64) << 8 | flat[1:]].tolist()
        for k in missed:
            hi = lo + len(raw[k])
            ids += self._merge(raw[k], first[lo:hi], pairs[lo : hi - 1])
            edge.append(4 * len(ids))
            lo = hi
        merged = np.array(ids, "<u4").tobytes()
        for at, k in enumerate(missed):
            out[k] = merged[edge[at] : edge[at + 1]]
        return out

    def _known(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all the given pre-tokens. Beyond its size the cache ages, and of the aged one only what is met again is kept."""
        found = dict.fromkeys(words.intersection(self.cache))
        found.update(zip(found, map(self.cache.__getitem__, found), strict=True))
        rest = words.difference(found)
        again = {w: ids for w in rest if (ids := self.aged.get(w)) is not None}
        new = list(rest.difference(again))
        again.update(zip(new, self.encode_words(new), strict=True))
        if len(self.cache) + len(again) > CACHE_WORDS:
            self.aged, self.cache = self.cache, {}
        self.cache.update((w, ids) for w, ids in again.items() if len(w) <= CACHE_LENGTH)
        found.update(again)
        return found

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit bytes, in order."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (size < _BATCH_CHARS or hi == lo):
                size += len(texts[hi])
                hi += 1
            cut = [self.find(t) for t in texts[lo:hi]]
            get = self._known(set().union(*cut)).__getitem__
            for words in cut:
                yield b"".join(map(get, words))
            lo = hi

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> TieredBPE:
    """One encoder per rank file, pattern and Python worker, so that its tables and cache outlive a task."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TieredBPE(ranks, pattern)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def map_codec(docs: DataFrame, path: str, pattern: str, derive: Callable[[bytes, bytes], tuple], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``derive(ids as little-endian 32-bit bytes, decoded bytes)`` for every row; ``schema`` names the key and what it returns.

    One narrow pass without a shuffle: a lost task is simply run again.
    """
    names, types = zip(*(c.split() for c in schema.split(",")), strict=True)
    kinds = [_ARROW[t] for t in types[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in batches:
            if b.num_rows:
                rows = [derive(ids, bpe.decode(ids)) for ids in bpe.encode_many([t or "" for t in b.column(1).to_pylist()])]
                cols = [b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(cols, names=list(names))

    return docs.select(key, text).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)``."""
    return map_codec(docs, path, pattern, lambda ids, _: (np.frombuffer(ids, "<i4"),), f"{key} long, ids array<int>", key, text)


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, data binary)`` from an array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in batches:
            out = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "data"])

    return tokens.select(key, ids).mapInArrow(run, f"{key} long, data binary")


def digest(ids: bytes, decoded: bytes) -> tuple[int, str, str]:
    """Number of ids, hash of the decimal ids joined by a space, hash of the decoded bytes."""
    listed = np.frombuffer(ids, "<u4").tolist()
    return len(listed), hashlib.sha256(" ".join(map(str, listed)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()
