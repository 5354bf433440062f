"""Line dedup: lines that many documents share stay in one of them only.

The hash of every line key goes through one range partitioning by (hash, document descending, position) with a sort of
the same order, so that a hash that fills many partitions is split over them. A stream over each partition meets the
largest document of a key first; runs that touch a partition's edge are left open and settled by a count of their
documents. The result is a compressed bitmap of kept lines per document, not text.

Defined cases: a null or empty text is one empty line; rows of one doc_id with equal text share one bitmap, and rows
of one doc_id with different texts count as one document and get a bitmap each; rows with a null doc_id keep all their
lines; a key that repeats inside its largest document keeps all of them there; an empty table gives an empty result; a
very long text is cut into lines whole. Only doc_id and text are read, so other columns may bear any name.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm import _store, _text

BLANK = b" \t\n\v\f\r"
#: Rows that a stream holds at once.
HELD = 20_000
#: Tasks that the rows of one key are dealt to where its run was too long or met an edge.
SALTS = 64


def line_keys(text: bytes, least: int) -> dict[bytes, list[int]]:
    """Positions by 128-bit hash of the keys of at least `least` code points."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(BLANK).lower()
        if len(key) >= least and (key.isascii() or len(key.decode(errors="replace")) >= least):
            out.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
    return out


def _version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("version")


LINE = "h1 long, h2 long, doc_id long, version long, positions binary"
LINE_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _lines(least: int):
    def run(batches):
        for batch in batches:
            ids, texts, versions, rows = batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("version").to_pylist(), []
            for i, d in enumerate(ids):
                rows += [(h, d, versions[i], np.array(p, np.int32).tobytes()) for h, p in line_keys((texts[i].as_py() or "").encode(), least).items()]
                if len(rows) > 50_000 or (rows and i == len(ids) - 1):
                    hashes = np.frombuffer(b"".join(r[0] for r in rows), ">i8").reshape(-1, 2).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *(pa.array([r[k] for r in rows], LINE_KINDS[k + 1]) for k in (1, 2, 3))], names=["h1", "h2", "doc_id", "version", "positions"])
                    rows = []

    return run


def _arrow(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)


def _stream(least_docs: int):
    """Over rows in order of (h1, h2, doc_id descending, version): the rows that go, and as `open` all rows of runs that
    touch an edge of the partition or are too long to hold."""
    names = ["h1", "h2", "doc_id", "version", "positions", "open"]

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in names[:5])))
        runs = itertools.groupby(rows, key=lambda r: r[:2])
        out: list[tuple] = []
        ahead, leading = next(runs, None), True
        while ahead is not None:
            largest, n, last, mine, long = None, 0, None, [], False
            for r in ahead[1]:
                n, last = n + (r[2] != last), r[2]
                largest = r[2] if largest is None else largest
                mine.append(r)
                if len(mine) > HELD:
                    long = True
                    yield _arrow(names, [*LINE_KINDS, pa.bool_()], [(*x, True) for x in mine])
                    mine = []
            ahead = next(runs, None)
            if leading or long or ahead is None:
                out += [(*x, True) for x in mine]
            elif n >= least_docs:
                out += [(*x, False) for x in mine if x[2] != largest]
            leading = False
            if len(out) > HELD:
                yield _arrow(names, [*LINE_KINDS, pa.bool_()], out)
                out = []
        yield _arrow(names, [*LINE_KINDS, pa.bool_()], out)

    return run


def _bitmaps(batches):
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("doc_id", "version", "positions"))))
    out = []
    for (d, version), group in itertools.groupby(rows, key=lambda r: r[:2]):
        pos = np.unique(np.frombuffer(b"".join(r[2] for r in group), np.int32))
        bits = np.zeros(int(pos[-1]) + 1, np.uint8)
        bits[pos] = 1
        out.append((d, version, len(pos), zlib.compress(np.packbits(bits, bitorder="little").tobytes())))
        if len(out) > HELD:
            yield _arrow(["doc_id", "version", "n_dropped", "dropped"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], out)
            out = []
    yield _arrow(["doc_id", "version", "n_dropped", "dropped"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], out)


def keep_bitmaps(docs: DataFrame, least: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, version, n_dropped, dropped) for each document that loses lines; `dropped` is the zlib-compressed bitmap
    of its lines, least significant bit first, 1 for a line that goes. `version` is a hash of the text."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", "text", _version())
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("version")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _store.written(lines.mapInArrow(_lines(least), LINE), "line-keys")  # the range sample and the sort read it, not the texts
    streamed = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_stream(least_docs), LINE + ", open boolean")
    found = _store.written(streamed, "lines")
    opened = found.where("open")
    edges = opened.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest")).where(F.col("docs") >= least_docs)
    # Few keys are left open, but one of them may have most rows: its rows are dealt to `SALTS` tasks.
    salts = edges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = opened.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    settled = dealt.join(salts, ["h1", "h2", "salt"]).where("doc_id != largest").select("doc_id", "version", "positions")
    drops = found.where("NOT open").select("doc_id", "version", "positions").unionByName(settled)
    return drops.repartition(n, "doc_id", "version").sortWithinPartitions("doc_id", "version").mapInArrow(_bitmaps, "doc_id long, version long, n_dropped long, dropped binary")


def dropped_lines(bitmap: bytes | None, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n].astype(bool)
        out[: len(bits)] = bits
    return out


def kept_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the lines that stay."""
    mine = docs.select("doc_id", "text", _version())
    theirs = bitmaps.select("doc_id", "version", "dropped").hint("shuffle_hash")

    def run(batches):
        for b in batches:
            ids, texts, found = (b.column(k) for k in ("doc_id", "text", "dropped"))
            rows = []
            for i, d in enumerate(ids.to_pylist()):
                raw = (texts[i].as_py() or "").encode()
                lines = raw.split(b"\n")
                gone = dropped_lines(found[i].as_py(), len(lines))
                kept = b"\n".join(x for x, g in zip(lines, gone) if not g) if gone.any() else raw
                rows.append((d, len(lines), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield _arrow(["doc_id", "n_lines", "n_dropped", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()], rows)

    return mine.join(theirs, ["doc_id", "version"], "left").select("doc_id", "text", "dropped").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def kept_texts(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with `text` reduced to the lines that stay; other columns as they are."""
    doc, version, dropped = _text.unused(docs.columns, "__id", "__version", "__dropped")
    theirs = bitmaps.select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("dropped").alias(dropped)).hint("shuffle_hash")
    drop = F.pandas_udf(lambda texts, found: texts.combine(found, lambda t, b: t if b is None or t is None else "\n".join(x for x, g in zip(t.split("\n"), dropped_lines(b, t.count("\n") + 1)) if not g)), "string")
    joined = docs.join(theirs, (F.col("doc_id") == F.col(doc)) & (_version() == F.col(version)), "left")
    return joined.withColumn("text", F.when(F.col(dropped).isNull(), F.col("text")).otherwise(drop("text", dropped))).select(*docs.columns)
