"""Hashed word n-grams of whole texts, computed on Arrow buffers without per-word Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer single text is a part of its own.
PART_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PART_BYTES)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a text column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds.astype(np.int64)


def parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of bounded size: first row, end row, bytes, bounds within these bytes."""
    if not len(column):
        return
    data, bounds = buffers(column)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(bounds, bounds[low] + PART_BYTES, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high, data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low]
        low = high


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Separators of the plain word pattern: space and the control characters from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per lower-cased word, and the bounds of each row's words."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    low = LOWER[data]
    inside = ~SPACES[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first, final = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    final[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
    power, inverse = powers(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((low.astype(_U) + _U(1)) * power[:len(data)], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, bounds)


def _combined(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = np.full(len(at), (length * 0x2545F4914F6CDD1D) % (1 << 64), _U)
    for j in range(length):
        out += mixed(hashes[at + j] + _U(j + 1)) * _U((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
    return mixed(out)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct hashes of its ``size``-word shingles.

    A text with fewer words has its whole word sequence as one shingle; a text
    without words has none.
    """
    for low, high, data, bounds in parts(column):
        hashes, of = word_hashes(data, bounds)
        counts = np.diff(of)
        whole = np.zeros(0, _U)
        if len(hashes) >= size:
            whole = _combined(hashes, np.arange(len(hashes) - size + 1), size)
        for i in range(high - low):
            n = counts[i]
            if n >= size:
                h = np.sort(whole[of[i]:of[i + 1] - size + 1])
                yield low + i, h[np.concatenate(([True], h[1:] != h[:-1]))]
            elif n:
                yield low + i, _combined(hashes, of[i:i + 1], int(n))
            else:
                yield low + i, np.zeros(0, _U)
