"""BPE encoding and decoding over a contiguous rank array.

A short word is held as its part ids side by side with the merge rank of every adjacent pair.
The least rank is sought by a scan, the boundary under it is deleted, and only the two ranks
beside it are looked up again, until no pair has a rank. Words of like length are worked on
together, one array row each: every live row loses one part a round, so the array just gets
narrower. Words over ``SHORT`` bytes go through a heap over the same ranks instead, as scans
would cost their length squared.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex

SHORT = 48
NONE = np.int32(2**31 - 1)
_BATCH_BYTES = 4_000_000
#: Words of a generation of the cache. Beyond it the generation ages, and of the aged one only words that are met again are kept, so that memory is bounded.
CACHE_WORDS = 300_000

# The public patterns by which the two tokenizers split a text before merging.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on in order."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in keep else chr(spare))
        spare += b not in keep
    return out


class PairRanks:
    """Rank of an id pair by open addressing in two flat arrays; absent pairs give ``NONE``."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(10, int(len(keys) * 16).bit_length())
        self.shift, self.mult = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
        size = (1 << bits) + 64
        self.keys, self.vals, self.probes = np.full(size, 2**64 - 1, np.uint64), np.full(size, NONE, np.int32), 1
        for k, r, h in zip(keys.tolist(), ranks.tolist(), (keys * self.mult >> self.shift).astype(np.int64).tolist(), strict=True):
            n = 0
            while self.vals[h + n] != NONE:
                n += 1
            self.keys[h + n], self.vals[h + n] = k, r
            self.probes = max(self.probes, n + 1)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape, key = left.shape, (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)).ravel()
        at = (key * self.mult >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == key, self.vals[at], NONE)
        for n in range(1, self.probes):
            left_over = np.flatnonzero((out == NONE) & (self.vals[at + n - 1] != NONE))
            if not len(left_over):
                break
            there = at[left_over] + n
            hit = self.keys[there] == key[left_over]
            out[left_over[hit]] = self.vals[there[hit]]
        return out.reshape(shape)


class RankBPE:
    """Encoder and decoder for a byte-level BPE file in the ``tokenizers`` JSON form."""

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.word_level = spec["normalizer"] is not None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find = regex.compile(WORD_PATTERN if self.word_level else BYTE_PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split
        chars = byte_characters()
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = PairRanks(left << np.uint64(32) | right, np.arange(len(pairs), dtype=np.int32))
        back = {c: b for b, c in enumerate(chars)}
        names = {i: s for s, i in self.special.items()}
        self.piece = [b""] * (max([*vocab.values(), *names]) + 1)
        for s, i in vocab.items():
            if i not in names:
                body = s[: -len(self.suffix)] if self.suffix and s.endswith(self.suffix) else s
                self.piece[i] = bytes(back[c] for c in body) + (b" " if body != s else b"")
        for i, s in names.items():
            self.piece[i] = s.encode()
        self.cache: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    # -- merging -----------------------------------------------------------------------------

    def _merge_rows(self, parts: np.ndarray, take) -> None:
        """parts: rows of equal length; ``take(rows, ids)`` gets each row when it has no pair left."""
        rows = np.arange(len(parts))
        ranks = self.ranks.get(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if parts.shape[1] == 1:
                take(rows, parts)
                return
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            live = least != NONE
            if not live.all():
                take(rows[~live], parts[~live])
                rows, parts, ranks, at, least = rows[live], parts[live], ranks[live], at[live], least[live]
                if not len(rows):
                    return
            n, width = parts.shape
            each = np.arange(n)
            parts[each, at] = self.merged[least]
            parts = parts[np.arange(width) != at[:, None] + 1].reshape(n, width - 1)
            if width == 2:
                take(rows, parts)
                return
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(n, width - 2)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.ranks.get(parts[some, at[some] - 1], parts[some, at[some]])
            some = np.flatnonzero(at < width - 2)
            ranks[some, at[some]] = self.ranks.get(parts[some, at[some]], parts[some, at[some] + 1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        ids = self.first[raw].copy()
        ids[-1] = self.last[raw[-1]]
        ranks = self.ranks.get(ids[:-1], ids[1:])
        n, ids = len(ids), ids.tolist()
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(int(ranks[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(ranks != NONE).tolist()]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            r = int(self.ranks.get(np.array([ids[i]]), np.array([ids[j]]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = int(self.merged[r]), False, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                push(i, nxt[i])
            if prev[i] >= 0:
                push(prev[i], i)
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], np.uint32)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each non-empty word, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, which in by_length.items():
            if length > SHORT:
                for k in which:
                    out[k] = self._merge_long(words[k]).tobytes()
                continue
            for lo in range(0, len(which), 32768):
                some = which[lo : lo + 32768]
                raw = np.frombuffer(b"".join([words[k] for k in some]), np.uint8).reshape(-1, length)
                parts = self.first[raw]
                parts[:, -1] = self.last[raw[:, -1]]

                def take(rows: np.ndarray, ids: np.ndarray, some=some) -> None:
                    size, flat = 4 * ids.shape[1], np.ascontiguousarray(ids).astype("<u4").tobytes()
                    for i, r in enumerate(rows.tolist()):
                        out[some[r]] = flat[i * size : i * size + size]

                if length == 1:
                    take(np.arange(len(some)), parts)
                else:
                    self._merge_rows(parts, take)
        return out

    # -- texts -------------------------------------------------------------------------------

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # lower case goes letter by letter here, without the rule for a sigma at a word's end
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _units(self, text: str) -> list[str]:
        """Pieces of a text that are encoded each for itself: white-space runs of words, or the pattern's matches."""
        if self.word_level:
            return self.normalize(text).replace("\n", " ").split(" ")
        return self.find(text)

    def _learn(self, units: set[str]) -> None:
        new = units.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.aged, self.cache, new = self.cache, {}, units
        again = new.intersection(self.aged)
        self.cache.update(zip(again, map(self.aged.__getitem__, again), strict=True))
        new = list(new - again)
        if not self.word_level:
            self.cache.update(zip(new, self.merge_words([u.encode() for u in new]), strict=True))
            return
        plain = [u for u in new if u.isalpha()]
        mixed = [(u, self.find(u)) for u in new if not u.isalpha()]
        words = list({*plain, *(w for _, ws in mixed for w in ws)})
        ids = dict(zip(words, self.merge_words([w.encode() for w in words]), strict=True))
        for u in plain:
            self.cache[u] = ids[u]
        for u, ws in mixed:
            self.cache[u] = b"".join([ids[w] for w in ws])

    def encode_many(self, texts: list[str], special: bool = True):
        """Yields the ids of each text as little-endian 32-bit bytes, in order. special: strings of special tokens get their ids."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (size < _BATCH_BYTES or hi == lo):
                size += len(texts[hi])
                hi += 1
            cut, units = [], set()
            for t in texts[lo:hi]:
                if special and any(s in t for s in self.special):
                    pieces = [self.special[p] if p in self.special else self._units(p) for p in self.split_special(t)]
                else:
                    pieces = [self._units(t)]
                cut.append(pieces)
                for p in pieces:
                    if not isinstance(p, int):
                        units.update(p)
            self._learn(units)
            get = self.cache.__getitem__
            for pieces in cut:
                yield b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in pieces])
            lo = hi

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> RankBPE:
    """One encoder per file and Python worker, so that its table and cache outlive a task."""
    return RankBPE(path)
