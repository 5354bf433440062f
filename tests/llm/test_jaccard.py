import random
import re

import pytest

from gossamer.llm import jaccard


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    degree = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            n = len(a & b)
            if rows[i][0] is not None and rows[j][0] is not None and n and den * n >= num * (len(a) + len(b) - n):
                degree[i] += 1
                degree[j] += 1
                x, y = root(rows[i][0]), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else root(d), n) for (d, _), s, n in zip(rows, sets, degree)), key=repr)


def cases():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for c in range(25):
        base = rng.choices(vocabulary, k=rng.randint(3, 90))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((" ".join(w)).upper() if rng.random() < 0.2 else " \n ".join(w))
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows += [f"{passage} {' '.join(rng.choices(vocabulary, k=rng.randint(5, 60)))}" for _ in range(60)]
    # A chain: each is near the next, the first and the last are far apart.
    chain = rng.choices(vocabulary, k=120)
    for i in range(12):
        chain[i * 9] = f"new{i}"
        rows.append(" ".join(chain))
    rows += [None, "", " \t", "one", "ONE", "one two three", "same text here " * 3000, "same text here " * 3000]
    rng.shuffle(rows)
    out = list(enumerate(rows))
    return [*out, (None, rows[0]), (None, None)]


@pytest.mark.parametrize("k,num,den,group", [(4, 85, 100, 256), (5, 4, 5, 3), (2, 1, 2, 5)])
def test_equals_brute_force(spark, k, num, den, group, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", group)
    rows = cases()
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n int, gid string").repartition(4)
    got = sorted(map(tuple, jaccard.join(df, k, num, den).collect()), key=repr)
    want = brute(rows, k, num, den)
    assert got == want
    assert max(n for *_, n in want) >= 5


def test_one_of_each_and_empty_table(spark):
    rows = cases()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component string")
    kept = sorted((r.doc_id for r in jaccard.one_of_each(df).collect()), key=repr)
    want = sorted([r[0] for r in brute(rows, 5, 4, 5) if r[0] == r[2]], key=repr)
    assert kept == want
    assert jaccard.join(df.limit(0)).collect() == []


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(30)) if i % 2 else f"alone number {i} of many others", i) for i in range(8)] + [(None, "x", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns and sorted(r["__id"] for r in got.collect()) == [0, 1, 2, 4, 6, 99]


def test_groups_are_bounded_by_tokens(spark, monkeypatch):
    # Copies with a word more each: one key, far more tokens than a group may have.
    text = " ".join(f"w{j}" for j in range(200))
    rows = [(i, f"{text} {' '.join(f'x{k}' for k in range(i % 7))} y{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join(df).collect()}
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 1000)
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join(df).collect()} == want
    assert {v[0] for v in want.values()} == {0} and want[0][1] == 59
    groups = jaccard.grouped(jaccard.signed(df, 5, 4, 5)).groupBy("gid").sum("n").collect()
    assert len(groups) > 5
