"""Words of whole batches of texts, hashed without a Python object for each word.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, with A-Z
lower-cased. Its hash is a difference of two running sums of byte values times powers of an odd number modulo
2**64, then mixed. Two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes of text that are handled at once.
SLICE = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))[_LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with about `most` bytes of text: first row, last row + 1, their bytes, and row starts in these. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(max(lo + 1, np.searchsorted(at, at[lo] + most, "right") - 1))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word of texts that lie side by side in `data`, text i from at[i] to at[i + 1]."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, none
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * up, out=total[1:], dtype=U)
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
    return hashed, np.searchsorted(at, start, "right") - 1, start, end
