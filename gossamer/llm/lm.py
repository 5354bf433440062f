"""LM scoring with an Elias-Fano n-gram trie.

Level 1 has every distinct training token, by hash, with its count. Levels 2 and 3 have every word pair and triple of the
training rows. They lie in files, each a trie of its own for one range of triples in the order of word numbers: for each
word the range of its followers, for each pair the range of its third words. Ranges are Elias-Fano sequences of
pointers; the words in them are one Elias-Fano sequence, made monotone by adding the last value before the range, so that
a lookup adds that offset to the word's number and searches the successor. Discounted shares of the context and
interpolation weights are 16-bit logarithms. Tasks map the files into memory.

The model is interpolated: P(w) = (c+1)/(N+V+1); P(w|h) = max(c(hw)-D, 0)/c(h) + g(h) P(w|h') with g(h) = D n(h)/c(h), where
n(h) counts the distinct words that follow h. Of an unknown context, P(w|h) is P(w|h').

Texts are cut into pieces of a batch, kept as numbers of the piece's own words and the hashes of those. Tasks add up
what they count and shuffle it as packed blocks, one for each range, so no row a token passes through the engine. The ranges
are cut at quantiles of a sample of the triples, of about `most` occurrences each; the sample has a bearing on where the
cuts are and on nothing else. A frequent word or pair may span several files: what such files know of it is added up in
the model, which holds the two ends of each file. So no context is too frequent for one task; equal triples are added
up in the tasks before they are shuffled.

Defined cases: a null or empty text is the end token alone; without training documents N and V are 0 and every token
has probability 1; rows with a null doc_id are training rows; repeated rows count and are scored each; a very long text
is a piece of its own; doc_id may be of any type and other columns than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm import _store, _text
from gossamer.llm.elias_fano import EliasFano, dump, load

U = np.uint64
#: The hash that stands for the end of a document.
END = U(0x5851F42D4C957F2D)
DISCOUNT = 0.75
SCALE = 4096
#: Triples that a task adds up before it sends them.
HELD = 1 << 21
#: Triples sampled for each file to place the cuts.
SAMPLE = 64
#: Bytes of files read whole that a worker keeps, where the shared folder is not mounted.
CACHE = 256 << 20
_EXP = 10.0 ** (-np.arange(65536) / SCALE)
SCORE = [*(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))]


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * SCALE), 0, 65535).astype(np.uint16)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of rows of bytes, the end token after each row's words; each row's first (len+1)."""
    _, _, h, first = _text.words(data, off)
    n = np.diff(first) + 1
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.full(at[-1], END)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = h
    return out, at


def planes(values: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte: what they have in common compresses away."""
    v = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    width = max(1, int(np.bitwise_or.reduce(values.view(U))).bit_length() + 7 >> 3) if len(values) else 1
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(v[:, :width].T).tobytes(), 1)


def unplaned(raw: bytes) -> np.ndarray:
    width = raw[0]
    v = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((v.shape[1], 8), np.uint8)
    out[:, :width] = v.T
    return out.view(np.int64).reshape(-1)


def _new(*cols: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = functools.reduce(np.logical_or, [c[1:] != c[:-1] for c in cols])
    return out


def summed(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of cols, in order, with the sums of their counts (1 or more each)."""
    if len(cols) > 1:
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        at = np.flatnonzero(_new(*cols))
        return [c[at] for c in cols], np.add.reduceat(counts[order], at) if len(at) else counts
    key = np.sort(cols[0])
    at = np.flatnonzero(_new(key))
    key, total = key[at], np.diff(np.append(at, len(key)))
    more = np.flatnonzero(counts > 1)
    np.add.at(total, np.searchsorted(key, cols[0][more]), counts[more] - 1)
    return [key], total


def _deltas(key: np.ndarray) -> np.ndarray:
    return np.diff(key, prepend=key.dtype.type(0))


_levels: dict[tuple[str, str], dict] = {}


def _mapped(folder: str, name: str) -> dict:
    """The arrays of a file, mapped; the least recently used of those read whole go first."""
    key = folder, name
    got = _levels.pop(key, None)
    if got is None:
        uri = f"{folder}/{name}.trie"
        buffer = _store.mapped(uri)
        arrays = load(buffer)
        got = arrays | {x: EliasFano.load(arrays, x) for x in ("words", "pairs", "triples", "starts2", "starts3") if f"{x}.meta" in arrays}
        got["size"] = 0 if _store.mounted(uri) else len(memoryview(buffer))
        held = sum(v["size"] for v in _levels.values()) + got["size"]
        while _levels and (held > CACHE or len(_levels) > 4096):
            held -= _levels.pop(next(iter(_levels)))["size"]
    _levels[key] = got
    return got


@dataclass
class Model:
    """Where the files are and what all tasks need to know of them: a few numbers for each file."""

    folder: str
    bits: int
    total: int = 0
    distinct: int = 0
    #: Numbers of words before each file of level 1.
    bases: list[int] = field(default_factory=list)
    #: First triple of each file of levels 2 and 3 but the first file, as three arrays.
    cuts: tuple = ()
    #: Files that hold triples, and what the two ends of each are in all files together (nan: as in the file).
    files: np.ndarray | None = None
    ends: np.ndarray | None = None
    n_pairs: int = 0
    n_triples: int = 0

    @property
    def pad(self) -> int:
        """The number after the end of a text; the next one is any unknown word's."""
        return self.distinct

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (unknown: pad + 1) and count of sorted hashes."""
        ids, counts = np.full(len(hashes), self.pad + 1), np.zeros(len(hashes), np.int64)
        shift = U(64 - self.bits)
        cut = np.searchsorted(hashes >> shift, np.arange((1 << self.bits) + 1).astype(U))
        for s, (a, b) in enumerate(itertools.pairwise(cut)):
            if a < b and self.bases[s] < self.bases[s + 1]:
                p = _mapped(self.folder, f"level1-{s:05d}")
                pos, hit = p["words"].successor(hashes[a:b] & U((1 << int(shift)) - 1))
                ids[a:b] = np.where(hit, pos + self.bases[s], self.pad + 1)
                counts[a:b] = np.where(hit, p["counts"][np.minimum(pos, len(p["counts"]) - 1)], 0)
        return ids, counts

    def counts(self, low: int, high: int) -> np.ndarray:
        """Counts of the words of a range of numbers."""
        out = []
        for s, (a, b) in enumerate(itertools.pairwise(self.bases)):
            if max(a, low) < min(b, high):
                out.append(_mapped(self.folder, f"level1-{s:05d}")["counts"][max(low - a, 0) : high - a].astype(np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + 1) - np.log10(self.total + self.distinct + 1)

    def file_of(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
        """The file of each triple."""
        c1, c2, c3 = self.cuts
        lo, hi = np.searchsorted(c1, w1, "left"), np.searchsorted(c1, w1, "right")
        # Of words that are cut: how many of their cuts are not beyond the triple, by bisection.
        at = np.flatnonzero(lo < hi)
        a, b, x, y = lo[at], hi[at], w2[at], w3[at]
        while (go := a < b).any():
            mid = np.minimum(a + b >> 1, len(c1) - 1)
            passed = (c2[mid] < x) | (c2[mid] == x) & (c3[mid] <= y)
            a, b = np.where(go & passed, mid + 1, a), np.where(go & ~passed, mid, b)
        hi[at] = a
        return hi

    def packed(self, file: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> list[np.ndarray]:
        """Columns in whose order the triples of a file are: one where they fit into 63 bits in every file."""
        start = np.concatenate([[0], self.cuts[0]])
        width = self.distinct + 2
        pair = (w1 - start[file]) * width + w2
        return [pair * width + w3] if self.narrow else [pair, w3]

    @property
    def narrow(self) -> bool:
        c1 = np.concatenate([[0], self.cuts[0], [self.distinct]])
        return (int(np.diff(c1).max()) + 1) * (self.distinct + 2) ** 2 < 1 << 63

    def look_up(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray, ...]:
        """For triples with a known first word: the pair's share and its word's weight, the triple's share and its
        pair's weight. What is not there has share 0; an unknown pair has weight 1."""
        n = len(w1)
        s2, g1, s3, g2 = np.zeros(n), np.ones(n), np.zeros(n), np.ones(n)
        file = self.file_of(w1, w2, w3)
        by_file = np.argsort(file.astype(np.uint16) if len(self.files) < 1 << 16 else file, kind="stable")
        cut = np.searchsorted(file[by_file], np.arange(len(self.files) + 1))
        for f, (a, b) in enumerate(itertools.pairwise(cut)):
            if a == b or not self.files[f]:
                continue
            at = by_file[a:b]
            key = self.packed(file[at], w1[at], w2[at], w3[at])
            at = at[np.argsort(key[0]) if len(key) == 1 else np.lexsort(key[::-1])]
            p, ends = _mapped(self.folder, f"level3-{f:05d}"), self.ends[f]
            x, y, z = w1[at], w2[at], w3[at]
            new1 = _new(x)
            new2 = new1 | _new(y)
            # Distinct first words, then distinct pairs, then triples.
            c = x[new1] - p["origin"][0]
            there = (c >= 0) & (c < len(p["weights1"]))
            c = np.where(there, c, 0)
            low, high, offset = _range(p["starts2"], p["pairs"], c)
            weight = _EXP[p["weights1"][c]]
            for end, place in ((0, 0), (1, len(p["weights1"]) - 1)):
                if not np.isnan(ends[end, 0]):
                    weight[c == place] = ends[end, 0]
            weight[~there] = 1
            mine = (np.cumsum(new1) - 1)[new2]
            pos, hit = p["pairs"].successor(offset[mine] + y[new2].astype(U) + U(1))
            hit &= (pos >= low[mine]) & (pos < high[mine]) & there[mine]
            pos = np.where(hit, pos, 0)
            share, back = np.where(hit, _EXP[p["shares2"][pos]], 0.0), np.where(hit, _EXP[p["weights2"][pos]], 1.0)
            scale = np.ones(len(pos))
            for end, place in ((0, 0), (1, len(p["weights2"]) - 1)):
                if not np.isnan(ends[end, 1]):
                    here = hit & (pos == place)
                    share[here], back[here], scale[here] = ends[end, 1:]
            pair = np.cumsum(new2) - 1
            s2[at], g1[at], g2[at] = share[pair], weight[(np.cumsum(new1) - 1)], back[pair]
            # Third words of the pairs that are there.
            held = np.flatnonzero(hit)
            number = np.full(len(pos), -1)
            number[held] = np.arange(len(held))
            low, high, offset = _range(p["starts3"], p["triples"], pos[held])
            t = np.flatnonzero(hit[pair])
            mine = number[pair[t]]
            pos3, hit3 = p["triples"].successor(offset[mine] + z[t].astype(U) + U(1))
            hit3 &= (pos3 >= low[mine]) & (pos3 < high[mine])
            s3[at[t[hit3]]] = _EXP[p["shares3"][pos3[hit3]]] * scale[pair[t[hit3]]]
        return s2, g1, s3, g2

    def annotate(self, ids: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 unigram and log10 model probabilities of tokens; ids and counts are theirs."""
        lp1 = self.unigram(counts)
        if self.files is None or not len(ids):
            return lp1, lp1
        at, after = _follow(ids, first, self.pad)
        known = ids[at] < self.pad
        at, after = at[known], after[known]
        s2, g1, s3, g2 = self.look_up(ids[at], ids[at + 1], after)
        p = 10.0**lp1
        p[at + 1] = s2 + g1 * p[at + 1]
        # The third word belongs to the same text where it is not the pad.
        t = after != self.pad
        p[at[t] + 2] = s3[t] + g2[t] * p[at[t] + 2]
        return lp1, np.log10(p)


def _follow(ids: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next token is of the same row, and the token after that (pad: none)."""
    last = np.zeros(len(ids), bool)
    last[first[1:] - 1] = True
    at = np.flatnonzero(~last)
    after = np.append(ids, pad)[at + 2]
    after[last[at + 1]] = pad
    return at, after


def _range(starts: EliasFano, words: EliasFano, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From, to and the last value before the ranges of contexts."""
    low, high = starts.access(context).astype(np.int64), starts.access(context + 1).astype(np.int64)
    offset = np.zeros(len(low), U)
    inner = np.flatnonzero(low > 0)
    offset[inner] = words.access(low[inner] - 1)
    return low, high, offset


def _monotone(starts: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Word numbers + 1 of ranges in order, on top of the last value of the range before."""
    n = np.diff(starts)
    last = word[starts[1:][n > 0] - 1] + 1
    return np.repeat(np.concatenate([[0], np.cumsum(last)[:-1]]), n[n > 0]) + word + 1


def held_out(folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def _small(c: np.ndarray) -> np.ndarray:
    return c.astype(next((t for t in (np.uint16, np.uint32) if not len(c) or c.max() <= np.iinfo(t).max), np.int64))


def _blocks(part: np.ndarray, cols: list[np.ndarray], counts: np.ndarray | None, parts: int):
    """Batches of (part, keys, more, counts): rows of cols dealt to parts, each part's added up and packed."""
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    out, size = [], 0

    def batch():
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=["part", "keys", "more", "counts"])

    for k, (a, b) in enumerate(itertools.pairwise(cut)):
        if a < b:
            at = order[a:b]
            key, total = summed([c[at] for c in cols], np.ones(b - a, np.int64) if counts is None else counts[at])
            out.append((k, planes(_deltas(key[0])), planes(key[1]) if len(key) > 1 else None, planes(total)))
            size += sum(len(x) for x in out[-1][1:] if x)
        if size > 4 << 20:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


BLOCK = "part int, keys binary, more binary, counts binary"


def _parts(batches):
    """(part, distinct rows, counts) of rows in order of part."""
    rows = (r for b in batches for r in zip(*(b.column(c) for c in ("part", "keys", "more", "counts"))))
    for part, group in itertools.groupby(rows, key=lambda r: r[0].as_py()):
        keys, more, counts = [], [], []
        for _, k, m, c in group:
            keys.append(np.cumsum(unplaned(k.as_py())))
            counts.append(unplaned(c.as_py()))
            if m.is_valid:
                more.append(unplaned(m.as_py()))
        cols = [np.concatenate(keys)] + ([np.concatenate(more)] if more else [])
        yield part, *summed(cols, np.concatenate(counts))


def _piece(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a piece's words, tokens as positions among them, first of each row, whether each row is held out."""
    return np.cumsum(unplaned(row["hashes"])).view(U), unplaned(row["ids"]), unplaned(row["first"]), np.array(row["held_out"], bool)


def _rows(batches, *names: str):
    for batch in batches:
        for r in range(batch.num_rows):
            yield {n: batch.column(n)[r].as_py() for n in names}


PIECE = ("hashes", "ids", "first", "held_out")


def encoded(docs: DataFrame) -> DataFrame:
    """docs in pieces, written: doc_ids, held_out, first, hashes, ids."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("held_out", T.ArrayType(T.BooleanType())), *(T.StructField(n, T.BinaryType()) for n in ("first", "hashes", "ids"))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [tokens(data, off) for _, _, data, off in _text.text_pieces(batch, "text")]
            h = np.concatenate([g[0] for g in got])
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(g[1]) for g in got]))])
            u, back = np.unique(h, return_inverse=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in ("doc_id", "held_out")]
            raw = [pa.array([planes(x)], pa.binary()) for x in (first, _deltas(u.view(np.int64)), back)]
            yield pa.RecordBatch.from_arrays([*lists, *raw], names=schema.names)

    return _store.written(docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema), "encoded")


def train(docs: DataFrame, most: int | None = None) -> tuple[Model, DataFrame]:
    """Counts the training rows and writes the trie, with about `most` occurrences to a file. Returns the model, which
    says where that is, and docs in pieces, ready to be scored."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = encoded(docs)
    bits = max(1, (n - 1).bit_length())
    model = Model(_store.new_path(spark, "trie"), bits)

    def unigrams(batches):
        held, size = [], 0

        def flush():
            cols, counts = summed([np.concatenate([x[0] for x in held])], np.concatenate([x[1] for x in held]))
            return cols[0], counts

        def out(key, counts):
            return _blocks((key.view(U) >> U(64 - bits)).astype(np.int64), [key], counts, 1 << bits)

        for row in _rows(batches, *PIECE):
            h, ids, first, away = _piece(row)
            c = np.bincount(ids[np.repeat(~away, np.diff(first))], minlength=len(h))
            held.append((h[c > 0].view(np.int64), c[c > 0]))
            size += len(held[-1][0])
            if size > 2 * HELD:
                held = [flush()]
                size = len(held[0][0])
                if size > HELD:
                    yield from out(*held[0])
                    held, size = [], 0
        if size:
            yield from out(*flush())

    def put1(batches):
        for part, (key,), c in _parts(batches):
            words = EliasFano.of(key.view(U) & U((1 << (64 - bits)) - 1))
            _store.put(f"{model.folder}/level1-{part:05d}.trie", dump(words.arrays("words") | {"counts": _small(c)}))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(c)], pa.int64()), pa.array([int(c.sum())], pa.int64())], names=["part", "n", "total"])

    found = pieces.select(*PIECE).mapInArrow(unigrams, BLOCK)
    rows = dealt(found, 1 << bits).mapInArrow(put1, "part int, n long, total long").collect()  # one a file
    sizes = {r.part: r.n for r in rows}
    model.bases = [0, *itertools.accumulate(sizes.get(s, 0) for s in range(1 << bits))]
    model.total, model.distinct = sum(r.total for r in rows), model.bases[-1]
    _store.free(spark)
    if not model.distinct:
        return model, pieces
    known = Model(**model.__dict__)

    def triples(row):
        h, ids, first, away = _piece(row)
        used = np.zeros(len(h), bool)
        keep = np.repeat(~away, np.diff(first))
        ids = ids[keep]
        used[ids] = True
        number = np.zeros(len(h), np.int64)
        number[used] = known.words(h[used])[0]
        at, after = _follow(ids := number[ids], np.concatenate([[0], np.cumsum(np.diff(first)[~away])]), known.pad)
        return ids[at], ids[at + 1], after

    most = most or min(1 << 22, max(1 << 18, model.total >> 6))
    step = max(1, most // SAMPLE)

    def sample(batches):
        for row in _rows(batches, *PIECE):
            got = triples(row)
            take = slice(int(_text.mix(np.array([len(got[0])], U))[0] % U(step)), None, step)
            yield pa.RecordBatch.from_arrays([pa.array(g[take]) for g in got], names=["a", "b", "c"])

    got = pieces.select(*PIECE).mapInArrow(sample, "a long, b long, c long").toArrow()  # SAMPLE rows a file
    known.cuts = model.cuts = _cuts(*(got.column(x).to_numpy() for x in "abc"), max(1, most // step))
    files = len(model.cuts[0]) + 1

    def emitted(batches):
        held, size = [], 0

        def out():
            file, *cols = (np.concatenate(c) for c in zip(*held))
            return _blocks(file, cols, None, files)

        for row in _rows(batches, *PIECE):
            w = triples(row)
            file = known.file_of(*w)
            held.append((file, *known.packed(file, *w)))
            size += len(file)
            if size > HELD:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    start = np.concatenate([[0], model.cuts[0]])

    def put3(batches):
        width = known.distinct + 2
        for part, cols, c3 in _parts(batches):
            pair, w3 = np.divmod(cols[0], width) if len(cols) == 1 else cols
            at = np.flatnonzero(_new(pair))
            starts3 = np.append(at, len(pair))
            w1, w2 = np.divmod(pair[at], width)
            c2, n3 = np.add.reduceat(c3, at), np.diff(starts3)
            origin, w1 = int(w1[0] + start[part]), w1 - w1[0]
            starts2 = np.searchsorted(w1, np.arange(w1[-1] + 2))
            n2, c1 = np.diff(starts2), known.counts(origin, origin + int(w1[-1]) + 1)
            arrays = {"origin": np.array([origin])}
            for name, starts, word in (("2", starts2, w2), ("3", starts3, w3)):
                arrays |= EliasFano.of(starts).arrays(f"starts{name}") | EliasFano.of(_monotone(starts, word)).arrays("pairs" if name == "2" else "triples")
            arrays["weights1"] = quantised(np.maximum(DISCOUNT * n2, 1e-9) / np.maximum(c1, 1))
            arrays["shares2"], arrays["weights2"] = quantised((c2 - DISCOUNT) / c1[w1]), quantised(DISCOUNT * n3 / c2)
            arrays["shares3"] = quantised((c3 - DISCOUNT) / np.repeat(c2, n3))
            _store.put(f"{known.folder}/level3-{part:05d}.trie", dump(arrays))
            ends = [[origin + int(w1[i]), int(w2[i]), int(c1[w1[i]]), int(n2[w1[i]]), int(c2[i]), int(n3[i])] for i in (0, -1)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(w2)], pa.int64()), pa.array([len(w3)], pa.int64()), pa.array([ends[0]], pa.list_(pa.int64())), pa.array([ends[1]], pa.list_(pa.int64()))], names=["part", "n2", "n3", "head", "tail"])

    found = pieces.select(*PIECE).mapInArrow(emitted, BLOCK)
    rows = dealt(found, files).mapInArrow(put3, "part int, n2 long, n3 long, head array<long>, tail array<long>").collect()  # one a file
    _store.free(spark)
    model.files, model.ends = _joined(rows, files)
    shared = sum(a.tail[:2] == b.head[:2] for a, b in itertools.pairwise(sorted(rows, key=lambda r: r.part)))
    model.n_pairs, model.n_triples = sum(r.n2 for r in rows) - shared, sum(r.n3 for r in rows)
    return model, pieces


def dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks with a task for each part, in order of part where a task has several."""
    return blocks.repartition(parts, "part").sortWithinPartitions("part")


def _cuts(a: np.ndarray, b: np.ndarray, c: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every `each`-th of the triples, in order and once, lowered to the first of its word or pair unless that is cut
    twice: so a file has triples of every word and pair that its range touches."""
    order = np.lexsort((c, b, a))[each::each]
    a, b, c = a[order], b[order], c[order]
    if len(a):
        a, b, c = (x[_new(a, b, c)] for x in (a, b, c))
        again1 = np.concatenate([[False], a[1:] == a[:-1]])
        again2 = again1 & np.concatenate([[False], b[1:] == b[:-1]])
        b, c = np.where(again1, b, 0), np.where(again2, c, 0)
    return a, b, c


def _joined(rows: list, files: int) -> tuple[np.ndarray, np.ndarray]:
    """Which files there are, and for the two ends of each (word's weight, pair's share, pair's weight, factor of its
    triples' shares) where the word or the pair goes on in another file."""
    there, ends = np.zeros(files, bool), np.full((files, 2, 4), np.nan)
    rows = sorted(rows, key=lambda r: r.part)
    words: dict[int, list[int]] = {}
    pairs: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        there[r.part] = True
        for w1, w2, c1, n2, c2, n3 in (r.head, r.tail) if r.head[:2] != r.tail[:2] else (r.head,):
            p = pairs.setdefault((w1, w2), [0, 0, 0])
            p[:] = p[0] + c2, p[1] + n3, p[2] + 1
        for w1, n2 in {(x[0], x[3]) for x in (r.head, r.tail)}:
            w = words.setdefault(w1, [0, 0])
            w[:] = w[0] + n2, w[1] + 1
    for x, y in itertools.pairwise(rows):
        if x.tail[:2] == y.head[:2]:
            words[x.tail[0]][0] -= 1  # one pair, in both files
    for r in rows:
        for k, (w1, w2, c1, _, c2, _) in enumerate((r.head, r.tail)):
            n2, spread = words[w1]
            if spread > 1:
                ends[r.part, k, 0] = DISCOUNT * n2 / c1
            total, n3, spread = pairs[w1, w2]
            if spread > 1:
                ends[r.part, k, 1:] = (total - DISCOUNT) / c1, DISCOUNT * n3 / total, c2 / total
    return there, ends


def score(pieces: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and the scores of the rows of pieces."""
    kind = pieces.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *SCORE])

    def run(batches):
        for batch in batches:
            for r, row in enumerate(_rows([batch], *PIECE)):
                h, ids, first, _ = _piece(row)
                number, count = model.words(h) if model.distinct else (np.zeros(len(h), np.int64), np.zeros(len(h), np.int64))
                ids, counts = number[ids], count[ids]
                lp1, lp = model.annotate(ids, counts, first)
                at = first[:-1]
                cols = [batch.column(c)[r].values for c in ("doc_ids", "held_out")]
                sums = [np.add.reduceat((counts > 0).astype(np.int64), at), np.full(len(at), model.total, np.int64), np.add.reduceat(lp1, at), np.add.reduceat(lp, at)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first)), *(pa.array(x) for x in sums)], names=schema.names)

    return pieces.mapInArrow(run, schema)
