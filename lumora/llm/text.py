"""Vectorised word scanning over Arrow string arrays.

All kernels work on the UTF-8 bytes of a batch, in slices of bounded size, so that the
memory of a Python worker doesn't depend on how many rows or how long texts a batch has
(one text is the least slice). Nothing here touches Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space ends: all but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words of lower-case letters, digits and all characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = 0x9E3779B97F4A7C15 | 1
_Q = _U(0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * _U(pow(base, filled, 1 << 64))
        filled += step
    return out


class _Grown:
    """Powers of a number modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.have) < n:
            self.have = _powers(self.base, max(n, SLICE_BYTES + 4096))
        return self.have[:n]


_FORWARD, _BACKWARD = _Grown(_P), _Grown(pow(_P, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about limit bytes; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=kind, count=n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """The words of a slice: starts and ends in bytes, their row, and per row the first word's index."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, table: np.ndarray):
        self.low = LOWER[raw]
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[:-1] = table[self.low]
        rows = off[1:-1][off[1:-1] < len(raw)]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[rows] = inside[rows]
        last = np.zeros(len(raw) + 1, dtype=bool)  # the position after a word's last byte
        last[1:] = inside[:-1] & ~inside[1:]
        last[rows] |= inside[rows - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last)
        self.bounds = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """64 bits for each word's lower-cased bytes, equal wherever the word stands."""
        n = len(self.low)
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.low] * _FORWARD(n), out=sums[1:])
        own = (sums[self.ends] - sums[self.starts]) * _BACKWARD(n + 1)[self.starts]
        return mix(own + (self.ends - self.starts).astype(np.uint64) * _Q)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k neighbouring words, without regard to rows: len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _Q + hashes[i : i + n]
    return mix(out + _U(k))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; of all its words if they are fewer than k."""
    h = words.hashes()
    runs = grams(h, k)
    out = []
    for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        n = hi - lo
        if n >= k:
            own = np.sort(runs[lo : hi - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            out.append(own)
        else:
            out.append(grams(h[lo:hi], n) if n else h[:0])
    return out
