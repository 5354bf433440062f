"""Token-ID output: one wavelet matrix per shard.

A shard holds the token ids of whole documents in ascending doc_id order. Its file has, for each bit of an id from the
highest down, the bit-plane of the ids as the planes above have sorted them (zeros before ones), with the number of
ones before every block of `BLOCK` bits. That answers access, rank (how often an id occurs before a position) and
select (where its n-th occurrence is) from the one file, whose planes are compressed in blocks of `CHUNK` bytes so that
a lookup opens only the blocks it needs. Document ids and lengths follow as columns.

Documents are dealt by ranges of doc_id, so that shards are globally ordered; a shard ends after `SHARD` tokens, which
bounds what a task holds, and a document is never split. Files go to the shared folder under names that a repeated
task writes again.

Defined cases: a null or empty text has the end id alone; rows of one doc_id are kept, ordered by text; rows with a null
doc_id come first; an empty table gives no files; a very long text is a shard of its own. Special-token strings in a text are
ordinary text. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm import _store, _text

MAGIC = b"WVMX0001"
BLOCK = 512
CHUNK = 1 << 16
SHARD = 4_000_000
MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long"

_tokenizers: dict[str, Encoder] = {}


#: First bytes of characters among which there are blanks.
_MAYBE_BLANK = np.zeros(256, bool)
_MAYBE_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII marks that a run of letters ends before; the apostrophe is not one.
_MARK = np.array([chr(b) in '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' for b in range(256)])
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


class Encoder:
    """Ids of texts by a `tokenizers` file. Byte-level BPE begins a word anew at a single space or line end
    between non-blank characters and where a letter meets a mark, so a text is cut there and each distinct piece is
    encoded once; other tokenizers are refused. Pieces are
    known by a 64-bit hash of their bytes and length; `MOST` bounds how many a process remembers, so that some 10**13
    pieces are looked up before two are likely to be taken for one another."""

    MOST = 2_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        if parts["model"]["type"] != "BPE" or parts["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level BPE whose words can be encoded one by one")
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        # Characters of a byte-level token stand for one byte each.
        self.bytes_of = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        # Two sorted tables (hash, where its ids begin, how many): the small one takes new pieces.
        self.tables = [(none.astype(np.uint64), none, none), (none.astype(np.uint64), none, none)]
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def _known(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        data, off = _text.buffers(pa.array(texts, pa.large_string()))
        flat, at = self.encode(data, off)
        return [flat[a:b] for a, b in itertools.pairwise(at)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows of bytes, and each row's first (len+1)."""
        n = len(data)
        rows = len(off) - 1
        if not n:
            return np.zeros(0, self.dtype), np.zeros(rows + 1, np.int64)
        cut = np.zeros(n, bool)
        inner = np.flatnonzero((data == 0x20) | (data == 0x0A))
        inner = inner[(inner > 0) & (inner < n - 1)]
        inner = inner[~_MAYBE_BLANK[data[inner + 1]] & ~self._blank_before(data, inner)]
        cut[inner] = True
        cut[inner[data[inner] == 0x0A] + 1] = True
        mark = np.flatnonzero(_MARK[data])
        mark = mark[mark > 0]
        cut[mark[_LETTER[data[mark - 1]] | (data[np.maximum(mark - 2, 0)] == 0xC3) & (data[mark - 1] > 0x97) & (data[mark - 1] != 0xB7)]] = True
        cut[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        h = _text.slice_hashes(data, start, end)
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        where, count = self._find(u, data, start[at], end[at])
        size = count[back]
        place = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(where[back] - place[:-1], size) + np.arange(place[-1])]
        if self._known() > self.MOST:
            self.clear()
        return flat, place[np.searchsorted(start, off)]

    @staticmethod
    def _blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the character that ends before a byte may be a blank."""
        one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        return np.where(one < 0x80, _MAYBE_BLANK[one], (two == 0xC2) | (three >= 0xE1) & (three <= 0xE3))

    def _find(self, u: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where, count = np.full(len(u), -1), np.zeros(len(u), np.int64)
        for keys, begins, sizes in self.tables:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
                hit = keys[i] == u
                where[hit], count[hit] = begins[i[hit]], sizes[i[hit]]
        new = np.flatnonzero(where < 0)
        if not len(new):
            return where, count
        # Rows that alone hold more than MOST pieces exceed it, and encode() empties the tables after them.
        if self._known() and self._known() + len(new) > self.MOST:
            self.clear()
            return self._find(u, data, start, end)
        # Pieces that do not end in a blank are encoded many in a string: behind their own space, or else behind a line
        # end, which between non-blanks is a token of its own.
        spaced = data[start[new]] == 0x20
        joins = ~self._blank_before(data, end[new]) & (spaced & (end[new] > start[new] + 1) | ~_MAYBE_BLANK[data[start[new]]])
        raw = data.tobytes()
        order = np.concatenate([new[joins], new[~joins]])
        lead = np.concatenate([~spaced[joins], np.zeros(int((~joins).sum()), bool)])
        pieces = [raw[a:b] for a, b in zip(start[order].tolist(), end[order].tolist())]
        n_join = int(joins.sum())
        parts = [b"\n" + p if x else p for p, x in zip(pieces, lead.tolist())]
        width = end[order] - start[order]
        found, begin, count_new, used = [], [], [], self.used
        for i in range(0, n_join, 128 * 64):
            cuts = range(i, min(i + 128 * 64, n_join), 128)
            strings = [b"".join(parts[k : min(k + 128, n_join)]).decode() for k in cuts]
            for k, e in zip(cuts, self.tokenizer.encode_batch(strings, add_special_tokens=False)):
                ids, to = np.array(e.ids, self.dtype), min(k + 128, n_join)
                past = np.cumsum(self.bytes_of[ids])
                stop = np.cumsum(width[k:to] + lead[k:to])
                first, last = np.searchsorted(past, stop - width[k:to], "right"), np.searchsorted(past, stop, "right")
                found.append(ids)
                begin.append(used + first)
                count_new.append(last - first)
                used += len(ids)
        for i in range(n_join, len(pieces), 1000):
            for e in self.tokenizer.encode_batch([p.decode() for p in pieces[i : i + 1000]], add_special_tokens=False):
                found.append(np.array(e.ids, self.dtype))
                begin.append(np.array([used]))
                count_new.append(np.array([len(e.ids)]))
                used += len(e.ids)
        ids = np.concatenate(found)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(ids)), self.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used = used
        where[order], count[order] = np.concatenate(begin), np.concatenate(count_new)
        self._remember(u[new], where[new], count[new])
        return where, count

    def _remember(self, keys: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        def merged(a, b):
            k = np.concatenate([a[0], b[0]])
            o = np.argsort(k, kind="stable")
            return tuple(np.concatenate([x, y])[o] for x, y in zip(a, b))

        big, small = self.tables
        small = merged(small, (keys, begins, sizes))
        if len(small[0]) * 4 > len(big[0]):
            big, small = merged(big, small), tuple(x[:0] for x in small)
        self.tables = [big, small]


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def build(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Bit-planes (packed, most significant bit first) and the number of zeros in each."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    planes, zeros = [], []
    for bit in range(max(top, 1) - 1, -1, -1):
        ones = (ids >> ids.dtype.type(bit) & ids.dtype.type(1)).astype(bool)
        planes.append(np.packbits(ones).tobytes())
        low, high = np.compress(~ones, ids), np.compress(ones, ids)
        zeros.append(len(low))
        ids = np.concatenate([low, high])
    return planes, zeros


def dump(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file: header, index of compressed blocks, counts of ones, documents, blocks."""
    planes, zeros = build(ids)
    pack = zstandard.ZstdCompressor(level=1)
    blocks, counts = [], []
    for p in planes:
        blocks.append([pack.compress(p[i : i + CHUNK]) for i in range(0, len(p), CHUNK)])
        bits = np.bitwise_count(np.frombuffer(p + b"\0" * (-len(p) % (BLOCK // 8)), np.uint8).reshape(-1, BLOCK // 8)).sum(1)
        counts.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.uint32).tobytes())
    null = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    docs = pack.compress(null + np.array([d or 0 for d in doc_ids], np.int64).tobytes() + lengths.astype(np.int64).tobytes())
    ones = pack.compress(b"".join(counts))
    sizes = np.array([len(b) for bs in blocks for b in bs], np.uint32).tobytes()
    header = struct.pack("<8sqqii", MAGIC, len(ids), len(doc_ids), len(planes), ids.dtype.itemsize) + np.array(zeros, np.int64).tobytes()
    header += struct.pack("<iii", len(sizes), len(ones), len(docs))
    body = header + sizes + ones + docs + b"".join(b for bs in blocks for b in bs)
    return body + struct.pack("<I", zlib.crc32(body))


class WaveletMatrix:
    """Reads a shard's file; blocks are decompressed when a lookup needs them."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.n, self.n_docs, planes, size = struct.unpack_from("<8sqqii", self.data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.dtype, at = np.dtype(f"u{size}"), 32
        self.zeros = np.frombuffer(self.data, np.int64, planes, at).tolist()
        at += 8 * planes
        n_sizes, n_ones, n_docs = struct.unpack_from("<iii", self.data, at)
        at += 12
        sizes = np.frombuffer(self.data, np.uint32, n_sizes // 4, at).astype(np.int64)
        at += n_sizes
        un = zstandard.ZstdDecompressor()
        self.ones = np.frombuffer(un.decompress(bytes(self.data[at : at + n_ones])), np.uint32).reshape(planes, -1)
        at += n_ones
        docs = un.decompress(bytes(self.data[at : at + n_docs]))
        null = np.frombuffer(docs, np.uint8, self.n_docs)
        ids = np.frombuffer(docs, np.int64, self.n_docs, self.n_docs).tolist()
        self.doc_ids = [None if z else d for z, d in zip(null, ids)]
        self.lengths = np.frombuffer(docs, np.int64, self.n_docs, 9 * self.n_docs)
        starts = at + n_docs + np.concatenate([[0], np.cumsum(sizes)])
        self.places = starts.reshape(-1)[:-1].reshape(planes, -1) if len(sizes) else np.zeros((planes, 0), np.int64)
        self.sizes = sizes.reshape(planes, -1)
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def _chunk(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self._open:
            at = int(self.places[plane, k])
            raw = zstandard.ZstdDecompressor().decompress(bytes(self.data[at : at + int(self.sizes[plane, k])]))
            self._open[plane, k] = np.frombuffer(raw, np.uint8)
        return self._open[plane, k]

    def _ones_before(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        total = int(self.ones[plane, block])
        if rest:
            byte = block * (BLOCK // 8)
            part = self._chunk(plane, byte // CHUNK)[byte % CHUNK : byte % CHUNK + (rest + 7) // 8].copy()
            if rest % 8:
                part[-1] &= 0xFF00 >> rest % 8 & 0xFF
            total += int(np.bitwise_count(part).sum())
        return total

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane, z in enumerate(self.zeros):
            before = self._ones_before(plane, i)
            bit = int(self._chunk(plane, i // 8 // CHUNK)[i // 8 % CHUNK]) >> (7 - i % 8) & 1
            value = value << 1 | bit
            i = z + before if bit else i - before
        return value

    def _interval(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        for plane, z in enumerate(self.zeros):
            a, b = self._ones_before(plane, low), self._ones_before(plane, high)
            low, high = (z + a, z + b) if token >> (len(self.zeros) - 1 - plane) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        if token >> len(self.zeros):
            return 0
        low, high = self._interval(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of occurrence k (from 0) of token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._interval(token, 0)[0] + k
        for plane in range(len(self.zeros) - 1, -1, -1):
            bit, z = token >> (len(self.zeros) - 1 - plane) & 1, self.zeros[plane]
            at = self._select(plane, bit, at - z if bit else at)
        return at

    def _select(self, plane: int, bit: int, k: int) -> int:
        before = self.ones[plane].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        byte = block * (BLOCK // 8)
        part = np.unpackbits(self._chunk(plane, byte // CHUNK)[byte % CHUNK : byte % CHUNK + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - before[block]])

    def ids(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest up."""
        out = np.zeros(self.n, self.dtype)
        for plane in range(len(self.zeros) - 1, -1, -1):
            raw = np.concatenate([self._chunk(plane, k) for k in range(self.sizes.shape[1])]) if self.n else np.zeros(0, np.uint8)
            ones, z = np.unpackbits(raw, count=self.n).astype(bool), self.zeros[plane]
            # `out` has the bits below in this plane's outgoing order; put them back into its incoming order.
            back = np.empty_like(out)
            back[np.flatnonzero(~ones)] = out[:z]
            back[np.flatnonzero(ones)] = out[z:] | self.dtype.type(1 << (len(self.zeros) - 1 - plane))
            out = back
            for k in range(self.sizes.shape[1]):
                self._open.pop((plane, k), None)
        return out


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 0, shard: int = SHARD) -> DataFrame:
    """Writes the shards and returns their manifest: part, shard, path, n_docs, n_tokens."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), itertools.count()
        e = encoder(tokenizer)
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        held = 0

        def flush():
            k = next(number)
            path = f"{folder}/part-{part:06d}-{k:06d}.wvm"
            _store.put(path, dump(np.concatenate(ids), doc_ids, np.array([len(x) for x in ids])))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64())], names=["part", "shard", "path", "n_docs", "n_tokens"])

        last = np.array([end], e.dtype)
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for a, b, data, off in _text.text_pieces(batch, "text"):
                flat, place = e.encode(data, off)
                for d, x in zip(numbers[a:b], (flat[i:j] for i, j in itertools.pairwise(place))):
                    if held and held + len(x) >= shard:
                        yield flush()
                        ids, doc_ids, held = [], [], 0
                    ids.append(np.concatenate([x, last]))
                    doc_ids.append(d)
                    held += len(x) + 1
        if ids:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return _store.written(ordered.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian bytes of unsigned 32-bit integers) of every document in the files."""
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    # One row a partition: the sums before each.
    ahead = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("ahead"))
    placed = manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(ahead, "part").select("path", (F.col("ahead") + F.col("inside")).alias("base"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                m = WaveletMatrix(_store.get(path))
                ids = m.ids().astype("<u4")
                at = np.concatenate([[0], np.cumsum(m.lengths)])
                for k in range(0, m.n_docs, 2000):
                    to = min(k + 2000, m.n_docs)
                    raw = [ids[a:b].tobytes() for a, b in zip(at[k:to], at[k + 1 : to + 1])]
                    yield pa.RecordBatch.from_arrays([pa.array(m.doc_ids[k:to], pa.int64()), pa.array(base + at[k:to]), pa.array(m.lengths[k:to]), pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
