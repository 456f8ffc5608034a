"""Sets of word shingles as sorted 64-bit hashes, computed over whole texts with array operations.

Words are the runs outside the six ASCII white-space bytes, with A-Z lowered. A word's hash is a
polynomial over its bytes (each byte replaced by a random 64-bit value), taken from running sums, so
that no word is ever an object of its own. Five consecutive word hashes give a shingle's hash.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_CHUNK = 1 << 21
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D
_TURN = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | _ONE
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            step = np.full(n, b, np.uint64)
            step[0] = 1
            _POW[k] = np.cumprod(step)
    return _POW[0][:n], _POW[1][:n]


def word_hashes(flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``flat``, in pieces that end between words, so that memory is bounded."""
    hashes, starts, lo = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    raw_all = np.frombuffer(flat, np.uint8)
    while lo < len(flat):
        hi = min(len(flat), lo + _CHUNK)
        while hi < len(flat) and not _SPACE[flat[hi]]:
            step = _SPACE[raw_all[hi : hi + 4096]]
            hi = hi + int(step.argmax()) if step.any() else min(len(flat), hi + 4096)
        raw = raw_all[lo:hi]
        space = np.empty(len(raw) + 2, bool)
        space[0] = space[-1] = True
        space[1:-1] = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1])
        a, b = edge[::2], edge[1::2]
        up, down = _powers(len(raw))
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw] * up, out=total[1:])
        hashes.append(mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        starts.append(a + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str | None]):
    """Yields for each text the sorted distinct hashes of its shingles: whole sequence if under five words, nothing without words."""
    lo = 0
    while lo < len(texts):
        parts, size, hi = [], 0, lo
        while hi < len(texts) and (size < _CHUNK or hi == lo):
            parts.append((texts[hi] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            hi += 1
        ends = np.cumsum([len(p) + 1 for p in parts])
        words, starts = word_hashes(b"\n".join(parts))
        cut = np.concatenate([[0], np.searchsorted(starts, ends)])
        n = max(0, len(words) - WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(WORDS):
            rolled += words[k : k + n] * _TURN[k]
        rolled = mix(rolled)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    yield mix((words[a:b] * _TURN[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)
        lo = hi
