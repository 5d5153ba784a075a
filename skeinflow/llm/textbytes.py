"""Vectorised byte work on Arrow string columns, used inside Spark tasks.

Hashes are polynomial prefix sums modulo 2**64 over random byte values, so the
hash of any byte range costs two look-ups; a finaliser spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; the work arrays take about 60 bytes for each.
CHUNK_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def column_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (run of bytes other than 0x20 and 0x09-0x0D), and the word offsets of the rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class RangeHash:
    """Hashes of byte ranges; the same seed gives the same values everywhere."""

    def __init__(self, seed: int) -> None:
        raw = np.random.PCG64(seed).random_raw(257)
        self.table = raw[:256].astype(np.uint64)
        self.base = int(raw[256]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.power = self.unpower = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power), 1 << 16)
            for name, factor in (("power", self.base), ("unpower", self.inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (prefix[ends] - prefix[starts]) * self.unpower[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def run_hash(items: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every ``width`` consecutive items."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = np.random.PCG64(seed).random_raw(width).astype(np.uint64) | _U(1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += items[k : k + n] * odd[k]
    return mix(out)


def windows(row_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window that lies within one row, and that row; row_words are the rows' word offsets."""
    counts = np.maximum(np.diff(row_words) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + row_words[:-1][rows]
    return first, rows


def covered(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Marks of the n items that lie in a window of the given first items."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, np.minimum(first + width, n), -1)
    return np.cumsum(steps[:-1]) > 0
