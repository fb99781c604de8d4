"""Vectorised word and window hashing of Arrow string batches.

Every function works on the UTF-8 bytes of many texts at once. Hashes are polynomials modulo 2**64 of
odd base, so the hash of any byte or word range comes from one prefix sum; results are mixed before use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = (out[0], out[1])
    return _powers[base]


def forget() -> None:
    """Drops the power tables, which are as long as the longest array so far."""
    _powers.clear()


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Prefix:
    """Prefix sums of a polynomial over ``values``; ``of(start, end)`` hashes half-open ranges."""

    def __init__(self, values: np.ndarray, base: int = _WORD_BASE):
        power, self.inverse = _power_tables(base, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


@dataclass
class Words:
    """The words of consecutive texts. ``first[i]:first[i+1]`` are the words of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, length: int) -> np.ndarray:
        """Start indices of all ``length``-word windows inside one text."""
        counts = np.maximum(np.diff(self.first) - length + 1, 0)
        return ranges(self.first[:-1], counts)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+count[0]-1, start[1] .. and so on, as one array."""
    total = int(count.sum())
    skip = np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start, count) + np.arange(total) - skip


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    """Splits a string column at ASCII white space and hashes each word; ``lower`` folds A-Z first."""
    data, offsets = text_bytes(column)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _SEPARATOR[data]
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = gap[:-2]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = gap[1:].copy()
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    inside = ~gap[:-1]
    start, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    first = np.searchsorted(start, offsets)
    h = Prefix(data.astype(np.uint64) + np.uint64(1), _BYTE_BASE).of(start, end)
    return Words(data, start, end, first, mix(h + (end - start).astype(np.uint64)))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each (one row at least), to bound working memory."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each run of ``width`` consecutive values."""
    at, have = np.arange(len(h)), 1

    def join(a: np.ndarray, step: int) -> np.ndarray:
        x, y = a[: len(a) - step], a[step:]
        return np.where(h[x] <= h[y], x, y)

    while have < width:
        step = min(have, width - have)
        at, have = join(at, step), have + step
    return at
