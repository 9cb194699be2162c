"""Vectorised byte kernels over Arrow string columns.

Every kernel works on whole texts. ``pieces`` cuts a column into runs of at most 1024 documents and about
``PIECE`` bytes so that intermediate arrays stay in cache; a document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

# ASCII letters and digits and every byte of a multi-byte character belong to words
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows in them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE, rows: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows."""
    raw, offsets = string_parts(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, n, at + rows)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, PIECE + 4096)
        for k, base in enumerate((_P, _PINV)):
            x = np.full(m, U64(base))
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U64)
        if m > 8 * PIECE:  # not kept beyond one use
            out = (_powers[0][:n], _powers[1][:n])
            _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
            return out
    return _powers[0][:n], _powers[1][:n]


def words(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (n+1 entries)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    is_word = word[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a row begins here
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = is_word[:-1]
    before &= ~edge[:-1]
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal spans hash alike wherever they stand."""
    p, inv = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * p[:-1], dtype=U64, out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i, empty ranges giving 0."""
    if values.dtype == bool:
        return np.diff(np.searchsorted(np.flatnonzero(values), offsets))
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row of each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
