"""N-gram Jaccard join with a token-group matrix.

Sets of word shingles link when their Jaccard similarity reaches num/den. Equal sets are one class with one
representative. Classes are parted into groups of similar sets: by those two of four min-hashes which most classes
share, and by salt where those are more than `GROUP` or have more than `GROUP_TOKENS` tokens; a row of the matrix is a group with the union of its tokens and its members' tokens as positions in that
union. A query group and a group that share fewer than `SHARED` tokens of the members' prefixes (the rarest tokens, long
enough for that many to be common to any linked pair) cannot hold a link. For the others the number of a query's tokens in the group's union bounds its
overlap with every member, and only groups that some query may still reach are opened and compared exactly.

The order of rarity comes from a sketch of 2**SKETCH_BITS counters over all documents; any order gives the same
links. Nothing is capped: two groups of a split key meet like any others.

Defined cases: documents without words have no set, link with nothing and are their own component; fewer words than a
shingle make one shingle of all; a row with a null doc_id has no component (null) and takes no part; rows of one doc_id
count as linked; an empty table gives no rows; a very long text is compared whole and is a group of its own where its
set is larger than `GROUP_TOKENS`. Only doc_id and text are read, and other columns may have any names.
"""

from __future__ import annotations

import itertools
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm import _store, _text
from gossamer.llm.components import components

SKETCH_BITS = 18
BLOCK_BITS = 12
GROUP = 256
#: Tokens of a group's members in all, but for a single longer one.
GROUP_TOKENS = 1 << 18
#: Tokens that the prefixes of two linked sets share at least (or as many as the sets must share, if that is less).
SHARED = 4
U = np.uint64
SEEDS = (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25), U(0xD1B54A32D192ED03), U(0x8CB92BA72F3D8DD7))
#: Seeds of the min-hashes that documents are grouped by.
MINS = (U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47), U(0xC6BC279692B5C323), U(0xE7037ED1A0B428DB))
SIGNED = "doc_id long, n int, c1 long, c2 int, mins array<long>, prefix binary"


def _rows_of(batch: pa.RecordBatch, k: int):
    """(rows from, rows to, shingle hashes, first of each row) of a batch's text column."""
    for a, b, data, off in _text.text_pieces(batch, "text"):
        _, _, h, first = _text.words(data, off)
        yield a, b, *_text.shingles(h, first, k)


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counters of all shingles: each task sends one array, blocks of it are added up apart."""
    size = 1 << BLOCK_BITS

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, sh, _ in _rows_of(batch, k):
                total += np.bincount((sh >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        blocks = [(i // size, total[i : i + size].tobytes()) for i in range(0, len(total), size) if total[i : i + size].any()]
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary())], names=["block", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[b] = held.get(b, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition(1 << (SKETCH_BITS - BLOCK_BITS), "block").mapInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in summed.collect():  # 2**(SKETCH_BITS - BLOCK_BITS) rows
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.counts, np.int64)
    return (16 * np.log2(out + 1)).astype(np.uint16)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """96 bits of a set, from the sums of two mixes of its tokens."""
    a = int(_text.mix(s ^ SEEDS[2]).sum(dtype=U))
    b = int(_text.mix(s ^ SEEDS[3]).sum(dtype=U)) >> 32
    return a - (1 << 63), b - (1 << 31)


def signed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per document the size, fingerprint and min-hashes of its set, and the set's prefix."""
    rarity = docs.sparkSession.sparkContext.broadcast(sketch(docs, k))  # 2**SKETCH_BITS small numbers

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, sh, at in _rows_of(batch, k):
                rare = (rarity.value[(sh >> U(64 - SKETCH_BITS)).astype(np.int64)].astype(U) << U(44)) | (sh >> U(20))
                n, c1, c2, prefix = [], [], [], []
                mins = np.zeros((b - a, len(MINS)), np.int64)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    for k_, seed in enumerate(MINS):
                        mins[full, k_] = np.minimum.reduceat(_text.mix(sh ^ seed), at[:-1][full]).view(np.int64)
                for i in range(b - a):
                    s, where = np.unique(sh[at[i] : at[i + 1]], return_index=True)
                    take = min(len(s), len(s) - -(-num * len(s) // den) + SHARED)
                    order = np.argsort(rare[at[i] : at[i + 1]][where], kind="stable")[:take]
                    x, y = fingerprint(s)
                    n.append(len(s))
                    c1.append(x)
                    c2.append(y)
                    prefix.append(s[order].tobytes())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * len(MINS), pa.int32()), pa.array(mins.reshape(-1))), pa.array(prefix, pa.binary())], names=[x.split()[0] for x in SIGNED.split(", ")])

    return _store.mapped_table(docs.select("doc_id", "text"), "signed", run, SIGNED)


def grouped(sets: DataFrame) -> DataFrame:
    """Classes of equal sets: (c1, c2, n, rep, copies, gid)."""
    one = ["c1", "c2", "n"]
    classes = _store.mapped_table(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(*one).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("mins").alias("mins")), "classes")
    # Two min-hashes to a key: near copies mostly share some two of four, documents with a passage in common do not.
    two = [F.xxhash64(F.lit(i * len(MINS) + j), F.col("mins")[i], F.col("mins")[j]) for i, j in itertools.combinations(range(len(MINS)), 2)]
    keys = classes.select(*one, F.explode(F.array(*two)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where("size > 1")
    # Of a class's keys the one that most classes bear.
    best = keys.join(shared, "key").groupBy(*one).agg(F.max(F.struct("size", "key", "tokens")).alias("best"))
    size, key = F.col("best.size"), F.col("best.key")
    salts = F.greatest(F.ceil(size / GROUP), F.ceil(F.col("best.tokens") / GROUP_TOKENS))
    salted = F.xxhash64(key, F.pmod(F.xxhash64("c1", "c2"), salts))
    alone = size.isNull() | (F.col("n") > GROUP_TOKENS)
    gid = F.when(alone, F.xxhash64("c1", "c2", "n")).when(salts == 1, key).otherwise(salted)
    out = classes.join(best, one, "left").select(*one, "rep", "copies", gid.alias("gid"))
    out = _store.mapped_table(out, "groups")
    _store.forget(classes, sets.sparkSession)
    return out


def _unions(batches):
    """Rows in order of gid: the tokens of each group's prefixes once, with the range of its members' sizes."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("gid", "n", "prefix"))))
    out, held = [], 0
    names, kinds = ["token", "gid", "low", "high"], (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]) if out else [], t) for k, t in enumerate(kinds)], names=names)

    for gid, group in itertools.groupby(rows, key=lambda r: r[0]):
        token, low, high = None, 1 << 30, 0
        parts = []
        for _, n, prefix in group:
            low, high = min(low, n), max(high, n)
            parts.append(np.frombuffer(prefix, np.int64))
            if len(parts) > 512:
                parts = [np.unique(np.concatenate(parts))]
        token = np.unique(np.concatenate(parts))
        out.append((token, np.full(len(token), gid, np.int64), np.full(len(token), low, np.int32), np.full(len(token), high, np.int32)))
        held += len(token)
        if held > 200_000:
            yield batch()
            out, held = [], 0
    yield batch()


def _meetings(num: int, den: int):
    """Rows in order of token: pairs of groups with tokens in common and sizes that may link, the larger of their least
    sizes, and how many tokens."""

    def counted(found):
        g1, g2, low = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((g2, g1))
        g1, g2, low = g1[order], g2[order], low[order]
        at = np.flatnonzero(np.concatenate([[True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])]))
        return g1[at], g2[at], low[at], np.diff(np.append(at, len(g1)))

    def pairs(gid, low, high, run_start, run_len):
        found, size = [], 0
        # Runs of equal length are paired together; one long run is paired in slices.
        for m in np.unique(run_len):
            at = run_start[run_len == m]
            for j in range(1, m):
                i = np.arange(m - j)
                for part in np.array_split(at, max(1, len(at) * (m - j) // 400_000)):
                    a = (part[:, None] + i).reshape(-1)
                    b = a + j
                    may = (den * high[a] >= num * low[b]) & (den * high[b] >= num * low[a])
                    if may.any():
                        x, y = gid[a[may]], gid[b[may]]
                        found.append((np.minimum(x, y), np.maximum(x, y), np.maximum(low[a[may]], low[b[may]])))
                        size += len(x)
                if size > 1_000_000:
                    yield counted(found)
                    found, size = [], 0
        if found:
            yield counted(found)

    def run(batches):
        left = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if left is None:
                    break
                cols = left
                cut = len(cols[0])
            else:
                cols = [np.asarray(batch.column(k)) for k in range(4)]
                cols = cols if left is None else [np.concatenate(x) for x in zip(left, cols)]
                # The last run may go on in the next batch.
                cut = int(np.searchsorted(cols[0], cols[0][-1], "left")) if len(cols[0]) else 0
            token = cols[0][:cut]
            if len(token):
                start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                size = np.diff(np.append(start, len(token)))
                many = size > 1
                for p in pairs(cols[1][:cut], cols[2][:cut].astype(np.int64), cols[3][:cut].astype(np.int64), start[many], size[many]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in p], names=["g1", "g2", "low", "common"])
            left = [c[cut:] for c in cols]

    return run


def pack(reps: list[int], copies: list[int], sets: list[np.ndarray]) -> bytes:
    """A row of the matrix: members, the union of their tokens, and each member's tokens as positions in it."""
    union, where = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int32)
    # A single member is the whole union, in order.
    inside = zstandard.compress(where.astype(np.int32).tobytes(), 1) if len(sets) > 1 else b""
    return struct.pack("<ii", len(reps), len(union)) + np.array(reps, np.int64).tobytes() + np.array(copies, np.int64).tobytes() + union.tobytes() + sizes.tobytes() + inside


class Group:
    def __init__(self, blob: bytes):
        m, u = struct.unpack_from("<ii", blob)
        at = 8
        self.reps, self.copies = np.frombuffer(blob, np.int64, m, at), np.frombuffer(blob, np.int64, m, at + 8 * m)
        at += 16 * m
        self.union = np.frombuffer(blob, U, u, at)
        self.sizes = np.frombuffer(blob, np.int32, m, at + 8 * u).astype(np.int64)
        self.where = np.frombuffer(zstandard.decompress(blob[at + 8 * u + 4 * m :]), np.int32) if m > 1 else np.arange(u)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.owner = np.repeat(np.arange(m), self.sizes)

    def dense(self, rows: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
        """0/1 matrix of some members over the union's tokens that `column` numbers (-1: left out)."""
        out = np.zeros((len(rows), width), np.float32)
        number = np.full(len(self.reps), -1)
        number[rows] = np.arange(len(rows))
        r, c = number[self.owner], column[self.where]
        keep = (r >= 0) & (c >= 0)
        out[r[keep], c[keep]] = 1
        return out


def links(a: Group, b: Group, num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Members i of a and j of b with den * overlap >= num * union."""
    common, in_a, in_b = (a.union, np.arange(len(a.union)), np.arange(len(b.union))) if same else np.intersect1d(a.union, b.union, assume_unique=True, return_indices=True)
    none = np.zeros(0, np.int64)
    if not len(common):
        return none, none
    col_a, col_b = np.full(len(a.union), -1), np.full(len(b.union), -1)
    col_a[in_a] = np.arange(len(common))
    col_b[in_b] = np.arange(len(common))

    def reach(q: Group, col: np.ndarray, g: Group) -> np.ndarray:
        """Queries whose tokens in the group's union may make a link with its smallest fitting member."""
        bound = np.bincount(q.owner[col[q.where] >= 0], minlength=len(q.reps))
        least = np.maximum(g.sizes.min(), -(-num * q.sizes // den))
        return np.flatnonzero((num + den) * np.minimum(bound, g.sizes.max()) >= num * (q.sizes + least))

    rows, cols = reach(a, col_a, b), reach(b, col_b, a)
    if not len(rows) or not len(cols):
        return none, none
    # Only tokens of the members still in question.
    overlap = np.zeros((len(rows), len(cols)), np.int64)
    step = max(1, (1 << 22) // max(len(rows), len(cols), 1))
    for lo in range(0, len(common), step):
        ca, cb = (np.where((c >= lo) & (c < lo + step), c - lo, -1) for c in (col_a, col_b))
        width = min(step, len(common) - lo)
        overlap += np.rint(a.dense(rows, ca, width) @ b.dense(cols, cb, width).T).astype(np.int64)
    total = a.sizes[rows][:, None] + b.sizes[cols][None, :] - overlap
    ok = den * overlap >= num * total
    if same:
        ok &= rows[:, None] < cols[None, :]
    i, j = np.nonzero(ok)
    return rows[i], cols[j]


def _forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of the links x-y as many as tie the same nodes together."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for p, q in zip(x.tolist(), y.tolist()):
        r, s = root(p), root(q)
        if r != s:
            parent[max(r, s)] = min(r, s)
            out.append((p, q))
    return out


def _opened(num: int, den: int):
    """Rows (g1, g2, a, b): links of the two groups as a forest (add null), and what they add to each member's number
    of linked documents (b null)."""

    def run(batches):
        last: tuple[bytes, Group] | None = None
        for batch in batches:
            out: list[tuple] = []
            for g1, g2, x, y in zip(*(batch.column(c).to_pylist() for c in ("g1", "g2", "a", "b"))):
                if last is None or last[0] != x:
                    last = (x, Group(x))
                a = last[1]
                b = a if g1 == g2 else Group(y)
                i, j = links(a, b, num, den, g1 == g2)
                if not len(i):
                    continue
                add_a, add_b = np.bincount(i, b.copies[j], len(a.reps)), np.bincount(j, a.copies[i], len(b.reps))
                out += [(p, q, None) for p, q in _forest(a.reps[i], b.reps[j])]
                out += [(int(r), None, int(v)) for g, v_ in ((a, add_a), (b, add_b)) for r, v in zip(g.reps, v_) if v]
            kinds = (pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 3, kinds)], names=["a", "b", "add"])

    return run


def join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), n_links (documents
    that it links with, copies included)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = signed(docs, k, num, den)
    groups = grouped(sets)
    prefixes = groups.join(sets.select(F.col("doc_id").alias("rep"), "c1", "c2", "n", "prefix"), ["rep", "c1", "c2", "n"])
    tokens = prefixes.select("gid", "n", "prefix").repartition(n, "gid").sortWithinPartitions("gid").mapInArrow(_unions, "token long, gid long, low int, high int")
    met = tokens.repartition(n, "token").sortWithinPartitions("token").mapInArrow(_meetings(num, den), "g1 long, g2 long, low long, common long")
    needs = F.least(F.lit(SHARED), F.ceil(F.max("low") * num / den))
    met = met.groupBy("g1", "g2").agg(F.sum("common").alias("common"), needs.alias("needs")).where("common >= needs").select("g1", "g2")
    inner = groups.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    pairs = _store.mapped_table(met.where("g1 != g2").unionByName(inner), "pairs")
    needed = pairs.select(F.col("g1").alias("gid")).unionByName(pairs.select(F.col("g2").alias("gid"))).distinct()
    members = _store.mapped_table(groups.join(needed, "gid", "left_semi"), "members")

    def tokenised(batches):
        for batch in batches:
            c1, c2 = batch.column("c1").to_pylist(), batch.column("c2").to_pylist()
            for a, b, sh, at in _rows_of(batch, k):
                kept, sets = [], []
                for i in range(a, b):
                    s = np.unique(sh[at[i - a] : at[i - a + 1]])
                    if fingerprint(s) == (c1[i], c2[i]):
                        kept.append(i)
                        sets.append(s.tobytes())
                take = batch.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([take.column("gid"), take.column("rep"), take.column("copies"), pa.array(sets, pa.binary())], names=["gid", "rep", "copies", "tokens"])

    def matrix(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("gid", "rep", "copies", "tokens"))))
        for gid, group in itertools.groupby(rows, key=lambda r: r[0]):
            mine = {(r[1], r[3]): r for r in group}  # repeated rows once
            got = [mine[x] for x in sorted(mine)]
            blob = pack([r[1] for r in got], [r[2] for r in got], [np.frombuffer(r[3], U) for r in got])
            yield pa.RecordBatch.from_arrays([pa.array([gid], pa.int64()), pa.array([blob], pa.binary())], names=["gid", "blob"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(members.hint("shuffle_hash"), "rep")
    rows = texts.select("gid", "rep", "copies", "c1", "c2", "text").mapInArrow(tokenised, "gid long, rep long, copies long, tokens binary")
    table = _store.mapped_table(rows.repartition(n, "gid").sortWithinPartitions("gid"), "token-group-matrix", matrix, "gid long, blob binary")
    left = table.select(F.col("gid").alias("g1"), F.col("blob").alias("a"))
    right = table.select(F.col("gid").alias("g2"), F.col("blob").alias("b"))
    outer = pairs.where("g1 != g2").join(left, "g1").join(right, "g2").select("g1", "g2", "a", "b")
    within = pairs.where("g1 = g2").join(left, "g1").select("g1", "g2", "a", F.lit(None).cast("binary").alias("b"))
    found = _store.mapped_table(outer.unionByName(within), "links", _opened(num, den), "a long, b long, add long")
    for t in (pairs, members, table):
        _store.forget(t, spark)
    reached = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("rep"), "component")
    degree = found.where("add IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("add").alias("degree"))
    classes = groups.join(reached, "rep", "left").join(degree, "rep", "left").select("c1", "c2", "n", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("links"))
    out = sets.select("doc_id", "n", "c1", "c2").join(classes, ["c1", "c2", "n"], "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), mine.alias("component_id"), F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).alias("n_links"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs with the smallest doc_id of each component; rows with a null doc_id all stay."""
    [mine] = _text.unused(docs.columns, "__id")
    stay = join(docs, k, num, den).where("doc_id = component_id").select(F.col("doc_id").alias(mine)).distinct()
    kept = docs.join(stay, F.col("doc_id") == F.col(mine), "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL"))
