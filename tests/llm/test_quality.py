import random
import zlib

from gossamer.llm import quality


def corpus(n=400):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        ws = rng.choices(words, k=rng.randint(5, 40))
        rows.append((i, " ".join(ws) if good else " ".join(w.upper() + "!!" for w in ws)))
        labels.append((i, int(good)))
    return rows, labels


def test_learns_and_scores_all_rows(spark):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (None, "alpha beta"), (1002, "gamma " * 50_000), (3, "alpha")]
    docs = spark.createDataFrame([(d, t, 9.0) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    marks = spark.createDataFrame([*labels, (2, None), (5, 7), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, marks)
    got = quality.score(docs, model, ["doc_id"]).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted").collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    # Ids are no input: the same text has the same score.
    again = quality.score(docs.selectExpr("doc_id + 7 AS doc_id", "text"), model, ["doc_id"]).collect()
    assert {r.doc_id: r.score for r in again if r.doc_id == 1009} == {1009: next(r.score for r in got if r.doc_id == 1002)}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(docs, model, ["doc_id"]).collect()] == [0.5, 0.5]
    assert quality.score(docs.limit(0), model, ["doc_id"]).collect() == []


def test_accepted_rows_keep_their_columns(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, float(i or 0), None if (i or 0) % 9 else "x") for i, t in [*rows, (None, None), (7, "")]], "doc_id long, text string, score double, predicted string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    want = [r for r, s in zip(docs.collect(), quality.score(docs, model, []).collect()) if s.predicted]
    assert 0 < len(want) < len(rows)
    assert sorted(quality.accepted(docs, model).collect(), key=repr) == sorted(want, key=repr)
    assert quality.accepted(docs.limit(0), model).collect() == []


def test_score_equals_a_plain_model(spark):
    """The mean of the vectors of a document's features, a softmax layer, and the fold of both into one number a feature."""
    import numpy as np

    rng = np.random.default_rng(1)
    vectors, layer, bias = rng.normal(size=(1 << quality.BUCKET_BITS, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    model = quality.Model.folded(vectors, layer, bias)
    for text in ("", "one", "One two two THREE four  five\n", "Ünïcödé wörds here " * 30):
        data = np.frombuffer(text.encode(), np.uint8)
        found, _ = quality.features(data, np.array([0, len(data)]))
        words, grams = text.encode().split(), sum(max(0, len(data) - n + 1) for n in (3, 4))
        assert len(found) == len(words) + max(0, len(words) - 1) + grams
        z = (vectors[found].mean(0) if len(found) else np.zeros(4)) @ layer + bias
        p = np.exp(z - z.max())
        assert abs(model.scores(data, np.array([0, len(data)]))[0] - p[1] / p.sum()) < 1e-5
