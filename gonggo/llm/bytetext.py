"""Vectorised reading of Arrow text columns as UTF-8 bytes: rows, words, hashes.

Everything works on plain numpy arrays over the bytes of a bounded slice of a batch, so that one
task's memory depends on the slice and its longest text, not on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import TypeVar

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
# For steps whose arrays are many times their text, so that they take a few MB.
FINE_BYTES = 1 << 17

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


_Batch = TypeVar("_Batch", pa.RecordBatch, pa.Array)


def released(batches: Iterator[_Batch]) -> Iterator[_Batch]:
    """A task's batches; after the last one, what Arrow's pool keeps unused goes back, as the worker lives on."""
    yield from batches
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """`n` fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed)) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one uint8 array and its n + 1 row offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of up to `limit` bytes, or of one longer row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def byte_table(separators: bytes, others: bytes | None = None) -> np.ndarray:
    """Byte -> lower-cased byte (A-Z only), 0 for a separator.

    `others` names the ASCII bytes that make words; without it, all but the separators do.
    """
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    if others is not None:
        keep = np.zeros(256, bool)
        keep[list(others)] = True
        keep[128:] = True
        table[~keep] = 0
    table[list(separators)] = 0
    return table


# Words between blanks, and words of ASCII letters, digits and all other code points.
BLANK_WORDS = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
LETTER_WORDS = byte_table(b"", b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64; 4 MB of them for fine slices."""
    p = 0xD6E8FEB86659FD93
    up, down = np.full(size, p, np.uint64), np.full(size, pow(p, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray,
          longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never crosses rows.

    `longest` cuts longer words into pieces of that many bytes, counted from the word's start.
    """
    mapped = table[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = mapped != 0
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][np.diff(offsets) > 0]
    first[rows] = inside[rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[rows[rows > 0] - 1] = inside[rows[rows > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if longest and (ends - starts).max() > longest:
        pieces = -(-(ends - starts) // longest)
        begin = np.repeat(starts, pieces)
        nth = np.arange(len(begin)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = begin + nth * longest
        ends = np.minimum(starts + longest, np.repeat(ends, pieces))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's mapped bytes."""
    size = 1 << (18 if len(data) < 1 << 18 else max(int(len(data)).bit_length(), 20))
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[table[data]] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def window_hashes(hashes: np.ndarray, rows: np.ndarray, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every `n` consecutive words of one row, and whether the window stays in its row."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(count, np.uint64)
    for j, factor in enumerate(odd_numbers(n, seed * 1000 + n)):
        total += mix(hashes[j:j + count] + factor) * factor
    return mix(total), rows[:count] == rows[n - 1:]
