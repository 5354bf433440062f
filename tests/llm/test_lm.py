import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gossamer.llm import lm
from gossamer.llm.elias_fano import EliasFano, dump, load


@pytest.mark.parametrize("n,top", [(1, 5), (10, 10), (1000, 1 << 40), (5000, 6000), (3000, 1 << 62)])
def test_elias_fano_access_and_successor(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n).astype(np.uint64))
    e = EliasFano.load(load(dump(EliasFano.of(v).arrays("x"))), "x")
    assert (e.access(np.arange(len(v))) == v).all()
    q = np.concatenate([v, v + np.uint64(1), rng.integers(0, top, 500).astype(np.uint64), np.array([0, top], np.uint64)])
    pos, hit = e.successor(q)
    assert (pos == np.searchsorted(v, q)).all() and (hit == np.isin(q, v)).all()


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + [b"\0end"]


def plain_scores(rows):
    """The same model with dictionaries."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [words(t) for d, t in rows if not held(d)]
    one = Counter(w for t in train for w in t)
    total, distinct = sum(one.values()), len(one)
    two = Counter(p for t in train for p in zip(t, t[1:]))
    three = Counter(p for t in train for p in zip(t, t[1:], t[2:]))
    left = {}
    for counts, context in ((two, one), (three, two)):
        for k, c in counts.items():
            h = k[0] if len(k) == 2 else k[:2]
            left[h] = left.get(h, 1.0) - (c - lm.DISCOUNT) / context[h]
    p1 = lambda w: (one.get(w, 0) + 1) / (total + distinct + 1)

    def p2(a, w):
        lower = left.get(a, 1.0) * p1(w)
        return (two[a, w] - lm.DISCOUNT) / one[a] + lower if (a, w) in two else lower

    def p3(a, b, w):
        lower = left.get((a, b), 1.0) * p2(b, w)
        return (three[a, b, w] - lm.DISCOUNT) / two[a, b] + lower if (a, b, w) in three else lower

    out = []
    for d, t in rows:
        ws, s = words(t), 0.0
        for i, w in enumerate(ws):
            s += math.log10(p1(w) if i == 0 else p2(ws[i - 1], w) if i == 1 or (ws[i - 2], ws[i - 1]) not in two else p3(ws[i - 2], ws[i - 1], w))
        out.append((d, held(d), len(ws), sum(one.get(w, 0) > 0 for w in ws), total, sum(math.log10(p1(w)) for w in ws), s))
    return out


def check(spark, rows, most):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string").repartition(3)
    model, pieces = lm.train(df, most)
    got = [tuple(r) for r in lm.score(pieces, model).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for g, w in zip(sorted(got, key=key), sorted(plain_scores(rows), key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6 * w[2])
        assert g[6] == pytest.approx(w[6], abs=1e-3 * w[2])
    train = [words(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    assert model.n_pairs == len({p for t in train for p in zip(t, t[1:])})
    # A pair at the end of a text is kept with the pad as its third word.
    assert model.n_triples == len({p for t in train for p in zip(t, t[1:], [*t[2:], b"pad"])})
    return model


@pytest.mark.parametrize("most", [None, 100, 7, 1])
def test_scores_equal_a_plain_model(spark, most):
    # With few triples to a file, frequent words, pairs and triples span several of them.
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "THE"]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(42)], k=rng.randint(0, 60)))) for i in range(150 if most else 300)]
    rows += [(1000, None), (1001, ""), (None, "w1 w2 w3"), (5, "w1 w1 w1"), (1002, "neverseen w0 \t w1\nw2 " * 400)]
    model = check(spark, rows, most)
    if most:
        assert len(set(zip(*model.cuts))) == len(model.cuts[0]) > 20
        assert len(set(model.cuts[0])) < len(model.cuts[0])


@pytest.mark.parametrize("most", [None, 50])
def test_all_pairs_and_triples_are_stored(spark, most):
    # Rare phrases and a frequent word with many followers.
    rng = random.Random(7)
    rows = [(i, " ".join(x for k in range(rng.randint(0, 20)) for x in ("the", f"r{rng.randrange(400)}"))) for i in range(200)]
    rows += [(1000, "once upon a time"), (1001, "once upon a time"), (None, "once upon"), (1003, None), (1004, "a")]
    check(spark, rows, most)


def test_keys_of_two_columns(spark, monkeypatch):
    monkeypatch.setattr(lm.Model, "narrow", property(lambda self: False))
    rng = random.Random(11)
    check(spark, [(i, " ".join(rng.choices("abcdefg", k=rng.randint(0, 30)))) for i in range(60)], 40)


@pytest.mark.parametrize("rows", [[], [(2, "only held out")], [(0, None), (1, "")]])
def test_little_to_learn_from(spark, rows):
    rows = [(next(d for d in range(d, 99) if (zlib.crc32(str(d).encode()) % 7 == 2) == (d0 == 2)), t) for d0, t in rows for d in (d0,)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, pieces = lm.train(df)
    got = [tuple(r) for r in lm.score(pieces, model).collect()]
    assert sorted(g[:5] for g in got) == sorted(w[:5] for w in plain_scores(rows))
    assert all(g[6] <= 0 for g in got) and (model.total or all(g[6] == 0 for g in got))


def test_ids_may_be_texts(spark):
    model, pieces = lm.train(spark.createDataFrame([("a", "x y"), (None, "x")], "doc_id string, text string"))
    assert {r.doc_id for r in lm.score(pieces, model).collect()} == {"a", None}
