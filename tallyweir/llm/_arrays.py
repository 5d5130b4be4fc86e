"""Vectorised text kernels over Arrow string columns: words, hashes, per-document runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged; safe on UTF-8, whose longer characters use bytes from 0x80.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: a bijection of 64-bit numbers that scatters them well."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20))
_PLACE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = mix(np.arange(2 * n, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)
    return _PLACE


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in a row and each row's start (one more at the end); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of True; a run never spans two rows."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run; runs are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
    value = _BYTE[data[place + np.repeat(starts, sizes)]] * _places(int(sizes.max()))[place]
    return mix(np.add.reduceat(value, begins) ^ mix(sizes.astype(np.uint64)))


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each row's entries begin in the sorted array ``rows`` (n + 1 numbers)."""
    return np.searchsorted(rows, np.arange(n + 1))


def pack_words(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of the words ``[^\\x20\\x09-\\x0D]+`` of every text."""
    data, offsets = flat(column)
    if lower:
        data = LOWER[data]
    starts, ends, rows = runs(~SPACE[data], offsets)
    return run_hashes(data, starts, ends), rows


def word_shingles(column: pa.Array, size: int, lower: bool = True) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``size`` words in a row; fewer words make one, none make none."""
    words, rows = pack_words(column, lower)
    n = len(column)
    edge = bounds(rows, n)
    if len(words) >= size:
        held = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            held = mix(held ^ words[i : len(words) - size + 1 + i]) + np.uint64(i)
    else:
        held = np.zeros(0, np.uint64)
    out = []
    for i in range(n):
        a, b = int(edge[i]), int(edge[i + 1])
        if b - a >= size:
            x = np.sort(held[a : b - size + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif b > a:
            x = np.uint64(b - a)
            for w in words[a:b]:
                x = mix(np.array([x ^ w], np.uint64))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
