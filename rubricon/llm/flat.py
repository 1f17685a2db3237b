"""Texts of an Arrow batch as one flat byte array, cut into words with numpy.

The operators work inside Spark tasks on whole Arrow batches: a string column already is one
byte buffer with offsets, so words, hashes and sums are array operations, never a Python loop
over characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one round of array work takes; a longer document takes a round of its own, whole.
ROUND_BYTES = 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    return data, offsets - offsets[0]


def row_rounds(offsets: np.ndarray, limit: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about `limit` bytes each, at least one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def windows64(data: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as one integer (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans give equal hashes in every task."""
    at8, left = windows64(data), ends - starts
    h = (left.astype(np.uint64) + np.uint64(1)) * _M2
    live, at = None, starts
    while True:
        piece = at8[at] & _KEEP[np.minimum(left, 8)]
        mixed = ((h if live is None else h[live]) ^ (piece * _M1)) * _M2
        mixed ^= mixed >> np.uint64(29)
        if live is None:
            h, more = mixed, np.flatnonzero(left > 8)
            live, at, left = more, starts[more] + 8, left[more] - 8
        else:
            h[live] = mixed
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        if not len(live):
            h *= _M1
            return h ^ (h >> np.uint64(32))


def white(data: np.ndarray) -> np.ndarray:
    """Bytes that part words: space and 0x09-0x0D."""
    return (data == 0x20) | ((data - np.uint8(9)) < 5)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end) of the words `[^\\x20\\x09-\\x0D]+`."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = ~white(data)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts_here = inside[:-1].astype(bool)
    starts_here[1:] &= inside[:-2] == 0
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    starts_here[edge] = inside[edge] == 1
    ends_here = inside[:-1].astype(bool)
    ends_here &= inside[1:] == 0
    edge = offsets[1:-1]
    edge = edge[edge > 0]
    ends_here[edge - 1] = inside[edge - 1] == 1
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of `values[bounds[i]:bounds[i+1]]` for each row; exact for integers, empty rows 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def float_sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """As `sums_by_row`, without the rounding that differences of long running sums have."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(rows, weights=values, minlength=len(bounds) - 1)


def gather_spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all spans one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
