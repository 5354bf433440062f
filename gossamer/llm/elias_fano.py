"""Elias-Fano sequences over numpy buffers, with lookups of many values at once, and a file of named arrays."""

from __future__ import annotations

import json

import numpy as np

U = np.uint64
_ONES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)
#: Position of the k-th set bit of a byte.
_SELECT = np.array([[next((b for b in range(8) if i >> b & 1 and bin(i & (1 << b) - 1).count("1") == k), 8) for k in range(8)] for i in range(256)], np.uint64)


def _grouped(word: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Words of 64 bits with the bits of equal, ascending word numbers together."""
    out = np.zeros(size, U)
    if len(word):
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[at]] = np.bitwise_or.reduceat(bits, at)
    return out


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, one after another, and a word more."""
    n = len(values)
    if not width:
        return np.zeros(2, U)
    at = np.arange(n, dtype=np.int64) * width
    word, off = at >> 6, (at & 63).astype(U)
    out = _grouped(word, values << off, (n * width >> 6) + 2)
    over = np.flatnonzero(off > U(64 - width))
    out[word[over] + 1] |= values[over] >> (U(64) - off[over])
    return out


def _in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit of each word that has more than k."""
    s = x - (x >> U(1) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + (s >> U(2) & U(0x3333333333333333))
    # Byte b: how many bits are set in bytes 0 to b.
    s = (s + (s >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * _ONES
    more = np.bitwise_count((s | _TOPS) - (k + U(1)) * _ONES & _TOPS)
    shift = (U(8) - more.astype(U)) << U(3)
    before = s << U(8) >> shift & U(255)
    return shift + _SELECT[(x >> shift & U(255)).astype(np.int64), (k - before).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence: the low bits of each value packed, the high parts in unary. `ones` and `zeros` hold how
    many of them stand before each word of the unary part."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.lows, self.high, self.ones, self.zeros = n, low_bits, lows, high, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(U)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        lows = _packed(values & U((1 << low_bits) - 1), low_bits)
        at = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
        high = _grouped(at >> 6, U(1) << (at & 63).astype(U), (n + (top >> low_bits) >> 6) + 2)
        kind = np.uint32 if len(high) < 1 << 26 else np.int64
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, low_bits, lows, high, ones.astype(kind), (np.arange(len(ones)) * 64 - ones).astype(kind))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.lows": self.lows, f"{name}.high": self.high, f"{name}.ones": self.ones, f"{name}.zeros": self.zeros, f"{name}.meta": np.array([self.n, self.low_bits])}

    @classmethod
    def load(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = arrays[f"{name}.meta"].tolist()
        return cls(n, low_bits, *(arrays[f"{name}.{x}"] for x in ("lows", "high", "ones", "zeros")))

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th one or zero of the unary part; there are more than k."""
        held = self.ones if bit else self.zeros
        word = np.searchsorted(held, k.astype(held.dtype), "right") - 1
        x = self.high[word]
        return word * 64 + _in_word(x if bit else ~x, (k - held[word]).astype(U)).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(U)
        # Two shifts, for a shift by 64 is none.
        return (self.lows[word] >> off | self.lows[word + 1] << U(1) << (U(63) - off)) & U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, U)
        return (self._select(i, 1) - i).astype(U) << U(self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the position of the first value not below it, and whether that value is x."""
        x = np.asarray(x, U)
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high, low = x >> U(self.low_bits), x & U((1 << self.low_bits) - 1)
        zeros = int(self.zeros[-1])
        beyond = high >= U(zeros)
        h = np.minimum(high, U(zeros - 1)).astype(np.int64)
        # Values with this high part stand between two zeros.
        hi = self._select(h, 0) - h
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), 0) - h + 1, 0)
        end, open_ = hi.copy(), np.flatnonzero(lo < hi)
        while len(open_):
            a, b = lo[open_], hi[open_]
            mid = a + b >> 1
            less = self._low(mid) < low[open_]
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            lo[open_], hi[open_] = a, b
            open_ = open_[a < b]
        hit = lo < end
        hit[hit] = self._low(lo[hit]) == low[hit]
        return np.where(beyond, self.n, lo), hit & ~beyond


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """A header with each array's type, place and length, then the arrays, each on a multiple of 64 bytes."""
    entries, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        entries[name] = [a.dtype.str, at, len(a)]
        raw += b"\0" * (-len(raw) % 64)
        parts.append(raw)
        at += len(raw)
    head = json.dumps(entries).encode()
    head = len(head).to_bytes(8, "little") + head
    return head + b"\0" * (-len(head) % 64) + b"".join(parts)


def load(buffer) -> dict[str, np.ndarray]:
    """Views of the buffer: nothing is read before it is looked at."""
    view = memoryview(buffer)
    size = int.from_bytes(view[:8], "little")
    entries = json.loads(bytes(view[8 : 8 + size]))
    base = (8 + size + 63) // 64 * 64
    return {name: np.frombuffer(view, np.dtype(kind), n, base + at) for name, (kind, at, n) in entries.items()}
