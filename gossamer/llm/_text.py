"""Words, hashes and shingles of whole Arrow batches, with numpy.

A word is a run of bytes outside a separator table; ASCII separators never occur inside a UTF-8 sequence, so bytes
and characters give the same words. Hashes are 64 bits: sum T[byte] * P^position, taken for any slice from one running
sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, ASCII digits and bytes of other scripts.
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_T = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_P = 0x9E3779B97F4A7C15 | 5
_P_INV = pow(_P, -1, 2**64)
_pow = np.ones(1, U), np.ones(1, U)
PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        size = max(PIECE + 1, n)
        base = np.full(size, _P, U), np.full(size, _P_INV, U)
        for b in base:
            b[0] = 1
        _pow = np.cumprod(base[0]), np.cumprod(base[1])
    return _pow


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len+1 offsets from 0; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    else:
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, pa.scalar("" if pa.types.is_large_string(col.type) else b"", col.type))
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a longer row stands alone."""
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, len(off) - 1)
        at = to


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of bytes, A-Z lower-cased: start and end of each word, its hash, and each row's first word (len+1)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), np.zeros(len(off), np.int64)
    low = LOWER[data]
    w = ~sep[low]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    ends_of_rows = off[1:] - 1
    after[ends_of_rows[ends_of_rows >= 0]] = False
    ends = np.flatnonzero(w & ~after) + 1
    power, inverse = _powers(n + 1)
    run = np.empty(n + 1, U)
    run[0] = 0
    np.cumsum(_T[low] * power[:n], out=run[1:])
    h = mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(U))
    return starts, ends, h, np.searchsorted(starts, off)


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of slices of bytes as they are."""
    power, inverse = _powers(len(data) + 1)
    run = np.empty(len(data) + 1, U)
    run[0] = 0
    np.cumsum(_T[data] * power[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * inverse[start] + (end - start).astype(U))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and each row's first (len+1). A row of fewer words has its whole
    sequence as one shingle, a row without words none."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], U)
    if len(h) >= k:
        acc = np.zeros(len(h) - k + 1, U)
        for j in range(k):
            acc = acc * U(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
        acc = mix(acc)
        full = n >= k
        keep = np.repeat(first[:-1][full] - at[:-1][full], count[full])
        where = np.flatnonzero(np.repeat(full, count))
        out[where] = acc[where + keep]
    for r in np.flatnonzero((n > 0) & (n < k)):
        acc = np.full(1, n[r], U)
        for x in h[first[r] : first[r + 1]]:
            acc = acc * U(0xD6E8FEB86659FD93) + x
        out[at[r]] = mix(acc)[0]
    return out, at


def text_pieces(batch: pa.RecordBatch, column: str, most: int = PIECE):
    """(rows from, rows to, bytes, offsets) of a batch's text column, about `most` bytes at a time."""
    data, off = buffers(batch.column(column))
    for a, b in pieces(off, most):
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them (as Spark compares names, whatever their case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
