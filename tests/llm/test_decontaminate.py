import random
import re

import pytest

from gossamer.llm import decontaminate


def words(t):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=5, share=0.8):
    out = []
    for d, t in docs:
        w = words(t)
        for i, q in items:
            x = words(q)
            n = min(k, len(x))
            if not n:
                continue
            s = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}
            mine = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if len(s & mine) >= share * len(s) - 1e-9:
                out.append((d, i, len(s), len(s & mine)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randint(6, 60))) for i in range(30)] + [(100, "Only Three words"), (101, "one"), (102, None), (103, ""), (104, "..."), (0, "one"), (105, text(900))]
    docs = [(i, text(rng.randint(0, 200))) for i in range(60)]
    for i, (_, q) in enumerate(items[:30]):
        w = q.split()
        for _ in range(rng.randint(0, len(w) // 6)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((1000 + i, f"{text(50)}. {' '.join(w).upper()}! {text(3000 if i == 3 else 20)}"))
    docs += [(2000, None), (2001, ""), (None, items[0][1]), (1000, docs[60][1]), (2002, "x ONLY, three: words y"), (2003, items[-1][1])]
    return docs, items


@pytest.mark.parametrize("block", [20_000, 7])
def test_equals_brute_force(spark, block):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontaminate.search(df, benchmark, block=block).collect()), key=repr)
    want = brute(docs, items)
    assert got == want and len(want) > 12


def test_clean_and_empty_tables(spark):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, extra string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    bad = {d for d, *_ in brute(docs, items)}
    kept = [r.doc_id for r in decontaminate.clean(df, benchmark).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(d for d, _ in docs if d is not None and d not in bad)
    assert decontaminate.search(df.limit(0), benchmark).collect() == []
    assert decontaminate.search(df, benchmark.limit(0)).collect() == []
    assert decontaminate.clean(df, benchmark.limit(0)).count() == len(docs)


def test_clean_keeps_columns_of_any_name(spark):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, __row long").repartition(3)
    found = {r[0] for r in brute([(i, t) for i, (_, t) in enumerate(docs)], items)}
    got = decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == df.columns and sorted(r["__row"] for r in got.collect()) == [i for i in range(len(docs)) if i not in found]


def test_sketches_lose_nothing_that_is_contained():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, bound in ((1, 8), (8, 8), (9, 16), (40, 64), (64, 64)):
        sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(20)]
        part = decontaminate.Part(bound, 0.8, list(enumerate(sets)))
        for i, s in enumerate(sets):
            for _ in range(20):
                kept = rng.choice(s, decontaminate._least(n, 0.8), replace=False)
                doc = np.concatenate([kept, rng.integers(0, 1 << 63, 300).astype(np.uint64), kept[:3]])
                assert (0, i) in part.candidates(doc, np.array([0, len(doc)]))
