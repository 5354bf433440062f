"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are parted by the number of their shingles, and each part is an index of its own: the `k` smallest shingle hashes of
each of its items, with the part's `k`, and the largest of all these as the part's ceiling. A document is sketched for
each part by its shingle hashes up to the ceiling, so a long document gets a longer sketch where a sketch of fixed size
would lose a short item in it. An item of which a document holds enough misses at most as many hashes as its size and the
threshold allow, so `k` is that number and `SPARE` more, and a document that shares fewer than the rest cannot contain it:
recall is certain. What shares enough is verified by exact containment of the item's shingle set in the document's.

Words are lower-cased (A-Z) runs of ASCII letters, digits and bytes of other scripts. An item of fewer words than a
shingle is looked for as one shingle of its own length.

Defined cases: null, empty or wordless texts and items match nothing; repeated items and documents match each; equal
containments are all reported; rows with a null id are reported with a null; very long texts are sketched whole; an empty
table gives no rows; columns of other names are not read by `search` and kept by `clean`, whatever they are called.
Items are taken in blocks, each against all documents, so the size of the benchmark is not bounded by a broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm import _store, _text

U = np.uint64
SHINGLE = 5
#: Upper bounds of the parts by number of shingles; items above the last are a part each.
PARTS = (8, 16, 32, 64, 128, 256, 512, 1024)
#: Hashes of an item's sketch beyond those that a match may lack.
SPARE = 4
MATCH = "doc_id long, item_id long, n_shingles int, n_found int, containment double"


class Part:
    """The index of the items of one size: their sketches as sorted hashes, and what each item needs of its own."""

    def __init__(self, bound: int, share: float, members: list[tuple[int, np.ndarray]]):
        """members: numbers and shingle sets (sorted hashes) of items with at most `bound` shingles."""
        self.k = bound - _least(bound, share) + 1 + SPARE
        sketches = [(i, s[: self.k]) for i, s in members]
        keys, owner = np.concatenate([s for _, s in sketches]), np.repeat([i for i, _ in sketches], [len(s) for _, s in sketches])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.ceiling = self.keys[-1]
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(keys >> U(48)).astype(np.int64)] = True
        #: By item: how many hashes of its sketch a document with enough of it shares at least.
        self.needs = {i: max(1, min(self.k, len(s)) - (len(s) - _least(len(s), share))) for i, s in members}

    def candidates(self, sh: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) of documents whose sketches share enough with an item's."""
        # The documents' sketches: hashes up to the ceiling; most of them are not near any key.
        near = np.flatnonzero(sh <= self.ceiling)
        near = near[self.gate[(sh[near] >> U(48)).astype(np.int64)]]
        left, right = (np.searchsorted(self.keys, sh[near], side) for side in ("left", "right"))
        near, left, right = (x[right > left] for x in (near, left, right))
        if not len(near):
            return []
        rows = np.searchsorted(at, near, "right") - 1
        # A hash that a document repeats is one hash of its sketch.
        _, once = np.unique(np.stack([rows, left]), axis=1, return_index=True)
        rows, left, n = rows[once], left[once], (right - left)[once]
        spot = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pairs, shared = np.unique(np.stack([np.repeat(rows, n), self.owner[spot]]), axis=1, return_counts=True)
        return [(r, i) for r, i, c in zip(*pairs.tolist(), shared.tolist()) if c >= self.needs[i]]


def _least(n: int, share: float) -> int:
    """Shingles of n that a document must hold."""
    return math.ceil(share * n - 1e-9)


class Sketches:
    """The items of one block: their shingle sets, and the parts' indexes by shingle length."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int, share: float):
        self.share, self.k, self.items = share, k, []
        parted: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        data, off = _text.buffers(pa.array(texts, pa.string()))
        _, _, h, first = _text.words(data, off, _text.NON_WORD)
        for i, item in enumerate(ids):
            mine = h[first[i] : first[i + 1]]
            if not len(mine):
                continue
            length = min(k, len(mine))
            sh, _ = _text.shingles(mine, np.array([0, len(mine)]), length)
            s = np.unique(sh)
            size = next((p for p in PARTS if len(s) <= p), len(s))
            parted.setdefault((length, size), []).append((len(self.items), s))
            self.items.append((item, s))
        self.parts: dict[int, list[Part]] = {}
        for (length, size), members in sorted(parted.items()):
            self.parts.setdefault(length, []).append(Part(size, share, members))

    def matches(self, data: np.ndarray, off: np.ndarray):
        """(row, item, size of the item's set, shingles found) for rows of bytes."""
        _, _, h, first = _text.words(data, off, _text.NON_WORD)
        for length, parts in self.parts.items():
            sh, at = _text.shingles(h, first, length)
            sets: dict[int, np.ndarray] = {}
            for r, j in sorted(c for part in parts for c in part.candidates(sh, at)):
                if r not in sets:
                    sets = {r: np.unique(sh[at[r] : at[r + 1]])}
                item, s = self.items[j]
                n = int(np.isin(s, sets[r], assume_unique=True).sum())
                if n >= self.share * len(s) - 1e-9:
                    yield r, item, len(s), n


def _blocks(items: DataFrame, rows: int, size: int):
    """(ids, texts) of at most `rows` items and about `size` bytes; a longer item stands alone."""
    ids, texts, held = [], [], 0
    for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if ids and (len(ids) == rows or held + len(r.text) > size):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text)
    yield ids, texts


def search(docs: DataFrame, items: DataFrame, k: int = SHINGLE, share: float = 0.8, block: int = 20_000, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for every document that holds at least `share` of an item's
    shingles; one row for each pair of rows. What tasks are sent at once is one block of items."""
    spark = docs.sparkSession
    found = None
    blocks = _blocks(items, block, block_bytes)
    now = next(blocks)
    while now is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(Sketches(*now, k, share))

        def run(batches, shared=shared):
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for a, _, data, off in _text.text_pieces(batch, "text"):
                    out = [(ids[a + r], item, size, n, n / size) for r, item, size, n in shared.value.matches(data, off)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "item_id", "n_shingles", "n_found", "containment"])

        part = docs.select("doc_id", "text").mapInArrow(run, MATCH)
        if following is not None or found is not None:
            part = _store.written(part, "matches")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
        now = following
    return found


def clean(docs: DataFrame, items: DataFrame, k: int = SHINGLE, share: float = 0.8) -> DataFrame:
    """docs without those that contain an item, each row judged by its own text."""
    [row] = _text.unused(docs.columns, "__row")
    marked = docs.withColumn(row, F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = marked.select(F.col(row).alias("doc_id"), "text")
    hit = search(keyed, items, k, share).select(F.col("doc_id").alias(row)).distinct()
    return marked.join(hit, row, "left_anti").drop(row)
