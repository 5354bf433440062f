"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, word pairs and character 3- and 4-grams; a softmax layer
gives the two classes. A pair of equal words is one feature whichever word it is, for repetition marks poor text and the
pairs of rare words are never seen twice. Trained by numpy stochastic gradient descent, in one task, on a bounded sample of labelled rows
(`MOST_ROWS` and `MOST_BYTES`, the smallest seeded hashes of doc_id). The layer is linear in the mean, so scoring folds
each vector and the layer into one number: a table of 2**BUCKET_BITS floats, whatever the corpus.

Defined cases: a null or empty text scores by the bias alone; labels that are null or neither 0 nor 1 are ignored, and
of several labels of one doc_id the smallest counts; without both classes in the sample every score is the smoothed
share of label 1 (0.5 without rows); repeated rows are scored each; equal texts have equal scores, and rows at the
threshold are kept; very long texts are scored whole; columns of docs may have any names. Only text goes into a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm import _text

BUCKET_BITS = 17
#: The bounds of the labelled sample: rows, and bytes of whole texts after which no more rows are taken.
MOST_ROWS = 3000
MOST_BYTES = 64 << 20
DIM = 16
U = np.uint64


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all features of each row, and each row's first (len+1)."""
    shift = U(64 - BUCKET_BITS)
    starts, ends, h, first = _text.words(data, off)
    raw = data.astype(U)
    word = (h >> shift).astype(np.int32)
    # The case of a word's bytes is a feature of the character grams, not of the word.
    grams = []
    for n, seed in ((3, 0x9E3779B97F4A7C15), (4, 0xC2B2AE3D27D4EB4F)):
        if len(raw) < n:
            grams.append((np.zeros(0, np.int32), np.zeros(len(off), np.int64)))
            continue
        acc = raw[: len(raw) - n + 1].copy()
        for j in range(1, n):
            acc = acc << U(8) | raw[j : len(raw) - n + 1 + j]
        g = (acc * U(seed) >> shift).astype(np.int32)
        count = np.maximum(np.diff(off) - n + 1, 0)
        at = np.concatenate([[0], np.cumsum(count)])
        inside = np.repeat(off[:-1] - at[:-1], count) + np.arange(at[-1])
        grams.append((g[inside], at))
    count = np.maximum(np.diff(first) - 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    both = np.where(h[:-1] == h[1:], U(1), h[:-1] * U(3) + h[1:])
    pair = (_text.mix(both) >> shift).astype(np.int32)[np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])]
    parts = [(word, first - first[0]), (pair, at), *grams]
    rows = len(off) - 1
    sizes = np.stack([np.diff(f) for _, f in parts], 1)
    bounds = np.concatenate([[0], np.cumsum(sizes.reshape(-1))])
    out = np.empty(bounds[-1], np.int32)
    for k, (values, f) in enumerate(parts):
        begin = bounds[:-1].reshape(rows, len(parts))[:, k]
        out[np.repeat(begin - f[:-1], np.diff(f)) + np.arange(len(values))] = values
    return out, bounds[:: len(parts)]


class Model:
    """What scoring needs of the vectors and the layer: one number a bucket, and the bias."""

    def __init__(self, margin: np.ndarray, offset: float):
        self.margin, self.offset = margin, offset

    @classmethod
    def folded(cls, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> Model:
        return cls((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        f, first = features(data, off)
        run = np.concatenate([[0.0], np.cumsum(self.margin[f], dtype=np.float64)])
        mean = (run[first[1:]] - run[first[:-1]]) / np.maximum(np.diff(first), 1)
        return 1 / (1 + np.exp(-(mean + self.offset)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 3, rate: float = 0.3, seed: int = 7) -> Model:
    """Stochastic gradient descent, a document at a time, on the cross entropy of the softmax."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    vectors = ((rng.random((size, DIM)) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        share = (ones + 1) / (len(labels) + 2)
        vectors[:] = 0
        return Model.folded(vectors, layer, np.log([1 - share, share]))
    docs = []
    for t in texts:
        d = np.frombuffer(t, np.uint8)
        f, _ = features(d, np.array([0, len(d)]))
        b, c = np.unique(f, return_counts=True)
        docs.append((b, (c / max(1, len(f))).astype(np.float32)))
    steps, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            b, share = docs[i]
            lr = rate * (1 - steps / total)
            steps += 1
            hidden = share @ vectors[b]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            # A step of the whole text: the gradient of a vector is its share of the mean, scaled up to the text's size.
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            vectors[b] -= (lr * 20 * share)[:, None] * back
    return Model.folded(vectors, layer, bias)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, folds: int = 5, held_out: int = 0) -> Model:
    """From the labelled rows whose crc32(doc_id as text) mod folds is not held_out."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out)
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("order", F.xxhash64("doc_id", F.lit(11)))
    ids = sample.orderBy("order", "doc_id").limit(most).select("doc_id", "quality", "order")
    # At most `most` ids: small enough to send everywhere, whatever the tables hold.
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("quality").alias("quality"), F.first("order").alias("order"))

    def learn(batches):
        texts, marks, held = [], [], 0
        for batch in batches:
            for t, q in zip(batch.column("text"), batch.column("quality").to_pylist()):
                if held < MOST_BYTES:
                    texts.append(t.as_py().encode())
                    marks.append(q)
                    held += len(texts[-1])
        m = fit(texts, np.array(marks, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([m.margin.tobytes()], pa.binary()), pa.array([m.offset])], names=["margin", "offset"])

    # At most `most` rows for the one task.
    ordered = found.repartition(1).sortWithinPartitions("order", "doc_id").select("text", "quality")
    row = ordered.mapInArrow(learn, "margin binary, offset double").first()
    return Model(np.frombuffer(row.margin, np.float32), row.offset) if row else fit([], np.zeros(0, np.int64))


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """`keep` columns of docs with score (0 to 1) and predicted (1 from the threshold on), which win over columns of
    those names."""
    kept = [f for f in docs.schema.fields if f.name in keep and f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.margin, model.offset))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            for a, b, data, off in _text.text_pieces(batch, "__text"):
                part, s = batch.slice(a, b - a), m.scores(data, off)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.select(*names, F.col("text").alias("__text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least the threshold, with docs' own columns whatever they are called."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margin, model.offset))
    place = docs.columns.index("text")

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            data, off = _text.buffers(batch.column(place))
            keep = [m.scores(data[off[a] : off[b]], off[a : b + 1] - off[a]) >= threshold for a, b in _text.pieces(off)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))
