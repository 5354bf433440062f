"""WARC archives with an index merged from sorted capture runs.

Writing: each task writes one gzip member per record (equal payloads: a response once, revisits after it) and beside
each archive its capture run, a file sorted by URL key and timestamp. Merging: the key space is cut into ranges; a task
merges the slices of all runs that fall into its range with a loser tree, at most `FAN_IN` runs at a time (more are
merged in several passes), and writes one file of the globally ordered index. Reading: captures are read back from the
archives at the places the index gives.

Defined cases: a null payload is empty; of equal payloads every row with the smallest page_id is a response (repeated
rows too), a payload whose rows all have null ids is a response each time; a null url has the empty key; equal keys
and times are ordered by page_id, archive and offset; an empty table gives no records and an empty index; a very long
payload is one record. Only page_id, url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm import _store

FAN_IN = 64
#: Records of an archive; bytes at which an archive ends.
ARCHIVE = 64 << 20
ROWS = 4096
CAPTURE = [("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
CAPTURE_SQL = "url_key string, timestamp string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"
SCHEMA = pa.schema(CAPTURE)
BORN = datetime(2024, 1, 1, tzinfo=UTC)


def url_key(url: str | None) -> str:
    """The URL sorted by its host's labels from the right: com,example)/path?query, without scheme, www and fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/").lower() + (f"?{'&'.join(sorted(u.query.lower().split('&')))}" if u.query else "")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str, date: str, payload: bytes, refers_to: int | None, refers_date: str | None = None) -> bytes:
    """One record as a gzip member. A revisit carries the digest and size of the payload that it leaves out."""
    urn = lambda i: f"<urn:gossamer:page:{'' if i is None else i}>"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(refers_to))]
    else:
        body += payload
    head.append(("Content-Length", str(len(body))))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of each match, so a new head replays one path."""

    def __init__(self, runs: list[Iterable], key: Callable):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.heads = [self._next(k) for k in range(len(runs))]
        n = len(runs)
        self.tree = [-1] * max(n, 1)
        for k in range(n):
            self._replay(k)

    def _next(self, k: int):
        item = next(self.runs[k], None)
        return None if item is None else (self.key(item), k, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None:
            return False
        return y is None or x[:2] < y[:2]

    def _replay(self, k: int) -> None:
        node = (k + len(self.runs)) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = k
                return
            if self._beats(other, k):
                self.tree[node], k = k, other
            node //= 2
        self.tree[0] = k

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        while (top := self.heads[self.tree[0]]) is not None:
            yield top[2]
            k = self.tree[0]
            self.heads[k] = self._next(k)
            self._replay(k)


def merge(runs: list[Iterable], key: Callable) -> Iterator:
    return iter(LoserTree(runs, key))


def capture_order(c: tuple) -> tuple:
    return c[0], c[1], -(1 << 63) if c[2] is None else c[2], c[8], c[9]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows) if rows else [()] * len(CAPTURE), CAPTURE)], schema=SCHEMA)


def classified(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, first (the page_id of the response with this payload, where more than one row has it)."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    mine = pages.select("page_id", "url", "html", F.sha1(html).alias("__sha"), F.octet_length(html).alias("__n"))
    shared = mine.where(F.col("__n") >= least).groupBy("__sha", "__n").agg(F.min("page_id").alias("first"), F.count("*").alias("__rows")).where("__rows > 1 AND first IS NOT NULL").drop("__rows")
    return mine.join(shared.hint("shuffle_hash"), ["__sha", "__n"], "left").select("page_id", "url", "html", "first")


def timestamp(page_id: int | None) -> datetime:
    """Without a capture time of its own a page is taken to be captured page_id seconds after BORN."""
    return BORN + timedelta(seconds=(page_id or 0) % (10**9))


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes archives and capture runs; returns (run, splits): each run's path and its evenly spaced keys."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), itertools.count()
        out, captures = bytearray(), []

        def flush():
            nonlocal out, captures
            name = f"{part:06d}-{next(number):06d}"
            _store.put(f"{folder}/archive-{name}.warc.gz", bytes(out))
            captures = sorted(((*c[:8], f"{folder}/archive-{name}.warc.gz", *c[8:]) for c in captures), key=capture_order)
            sink = pa.BufferOutputStream()
            pq.write_table(_table(captures), sink, row_group_size=ROWS, compression="zstd")
            _store.put(f"{folder}/run-{name}.parquet", sink.getvalue().to_pybytes())
            splits = [c[0] for c in captures[:: max(1, len(captures) // 32)]]
            out, captures = bytearray(), []
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/run-{name}.parquet"]), pa.array([splits], pa.list_(pa.string()))], names=["run", "splits"])

        for batch in batches:
            cols = [batch.column(k) for k in ("page_id", "url", "html", "first")]
            for i in range(batch.num_rows):
                page, url, html, first = (c[i].as_py() for c in cols)
                payload, date = (html or "").encode(), timestamp(page)
                kind = "response" if first is None or first == page else "revisit"
                refers = first if kind == "revisit" else None
                member = record(kind, page, url or "", date.strftime("%Y-%m-%dT%H:%M:%SZ"), payload, refers)
                captures.append((url_key(url), date.strftime("%Y%m%d%H%M%S"), page, url, kind, digest32(payload), len(payload), refers, len(out), len(member)))
                out += member
                if len(out) >= ARCHIVE:
                    yield flush()
        if captures:
            yield flush()

    return _store.written(classified(pages, least).mapInArrow(run, "run string, splits array<string>"), "runs")


def _slice(path: str, low: str | None, high: str | None) -> Iterator[tuple]:
    """The captures of a run with low <= key < high, a row group at a time, groups outside the range unread."""
    fs, inner = _store.filesystem(path)
    with fs.open_input_file(inner) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            s = file.metadata.row_group(g).column(0).statistics
            if s is not None and s.has_min_max and (low is not None and s.max < low or high is not None and s.min >= high):
                continue
            t = file.read_row_group(g)
            keys = t.column(0).to_pylist()
            a, b = 0 if low is None else bisect.bisect_left(keys, low), len(keys) if high is None else bisect.bisect_left(keys, high)
            if a < b:
                yield from zip(*(c.to_pylist() for c in t.slice(a, b - a).columns))


def _write_captures(path: str, rows: Iterator[tuple]) -> int:
    """Streams captures into one file; the number of them, 0 without a file."""
    fs, inner = _store.filesystem(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    part, total = f"{inner}.{uuid.uuid4().hex[:8]}.part", 0
    with fs.open_output_stream(part) as sink, pq.ParquetWriter(sink, SCHEMA, compression="zstd") as out:
        while some := list(itertools.islice(rows, ROWS)):
            out.write_table(_table(some))
            total += len(some)
    if total:
        fs.move(part, inner)
    else:
        fs.delete_file(part)
    return total


def _merged_runs(spark, paths: list[str], folder: str) -> list[str]:
    """One pass: every FAN_IN runs become one."""
    some = [(k // FAN_IN, paths[k : k + FAN_IN]) for k in range(0, len(paths), FAN_IN)]

    def run(batches):
        for batch in batches:
            for k, files in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{folder}/run-{k:06d}.parquet"
                _write_captures(path, merge([_slice(p, None, None) for p in files], capture_order))
                yield pa.RecordBatch.from_arrays([pa.array([path])], names=["run"])

    table = spark.createDataFrame(some, "k int, files array<string>").repartition(len(some), "k")
    return sorted(r.run for r in table.mapInArrow(run, "run string").collect())


def index(runs: DataFrame, folder: str, ranges: int | None = None) -> DataFrame:
    """Merges the runs into globally ordered index files; returns (range, path, n) of those."""
    spark = runs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The cuts come from a bounded sketch of the runs' keys, not from the keys themselves.
    cut = runs.select(F.explode("splits").alias("k")).groupBy("k").count()
    n = cut.agg(F.sum("count")).first()[0] or 0
    step = max(1, n // ranges)
    ordered = cut.orderBy("k").toLocalIterator()
    cuts, seen = [], 0
    for r in ordered:
        if seen // step != (seen + r["count"]) // step and seen and len(cuts) < ranges - 1:
            cuts.append(r["k"])
        seen += r["count"]
    bounds = list(zip([None, *cuts], [*cuts, None]))
    table = spark.createDataFrame([(i, low, high) for i, (low, high) in enumerate(bounds)], "range int, low string, high string").repartition(len(bounds), "range")
    listing = f"{folder}/runs.txt"
    paths = [r.run for r in runs.select("run").orderBy("run").toLocalIterator()]
    level = 0
    while len(paths) > FAN_IN:
        paths, level = _merged_runs(spark, paths, f"{folder}/merged-{level}"), level + 1
    _store.put(listing, "\n".join(paths).encode())

    def run(batches):
        for batch in batches:
            for k, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                files = [p for p in _store.get(listing).decode().split("\n") if p]
                path = f"{folder}/index-{k:06d}.parquet"
                if total := _write_captures(path, merge([_slice(p, low, high) for p in files], capture_order)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([path]), pa.array([total], pa.int64())], names=["range", "path", "n"])

    return _store.written(table.mapInArrow(run, "range int, path string, n long"), "index")


def captures(indexed: DataFrame) -> DataFrame:
    """The index's captures, in order within each range."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = _store.filesystem(path)
                with fs.open_input_file(inner) as f:
                    yield from pq.ParquetFile(f).iter_batches(20_000)

    n = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return indexed.repartition(n, "range").mapInArrow(run, CAPTURE_SQL)


def records(indexed: DataFrame) -> DataFrame:
    """page_id, record_type, payload_digest, payload_bytes, refers_to, payload (null for revisits), all from the archived
    records, each read at the place its capture names. A record that breaks its own digest raises."""
    n = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = captures(indexed).select("archive", "offset", "length").repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    number = lambda s: int(s[len("<urn:gossamer:page:") : -1]) if len(s) > len("<urn:gossamer:page:>") else None

    def run(batches):
        name, f = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    fs, inner = _store.filesystem(archive)
                    name, f = archive, fs.open_input_file(inner)
                f.seek(offset)
                fields, payload = parse(f.read(length))
                sha, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (digest32(payload) != sha or len(payload) != size):
                    raise ValueError(f"{archive} at {offset}: the payload is not what the record says")
                rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Type"], sha, size, number(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])

    return placed.mapInArrow(run, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
