"""Whole texts as numpy byte blocks inside Arrow tasks: words, rolling hashes, sliding minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is a block of its own.
BLOCK = 1 << 21

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values, so that equal values stay equal and all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd, and 5 modulo 8, so that differences of powers keep almost all their bits.
RADIX = 0x9E3779B97F4A7C15
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and RADIX**-i modulo 2**64 for i <= n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 2)
        for k, base in enumerate((RADIX, pow(RADIX, -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers[0], _powers[1]


class Rolling:
    """Polynomial hashes of any spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null has no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and offsets of successive blocks of whole texts."""
    data, at = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word (a run without white space) of a block; no word crosses texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    white = WHITE[data]
    begins = np.zeros(n + 1, bool)
    begins[at[:-1]] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, white[:-1]
    after[-1], after[:-1] = True, white[1:]
    inside = ~white
    start = np.flatnonzero(inside & (before | begins[:-1]))
    end = np.flatnonzero(inside & (after | begins[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of every run of `width`, by the values' upper 36 bits (ties by place)."""
    key = (values & ~np.uint64((1 << 28) - 1)) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    return (key & np.uint64((1 << 28) - 1)).astype(np.int64)


def attach(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with more columns at the end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])
