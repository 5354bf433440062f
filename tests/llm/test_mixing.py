import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gossamer.llm import mixing

WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2, "xx": 0}, "source": {"s1": 5, None: 2}}


def shared(children, budget):
    """children {name: (weight, capacity)}: what fills up is taken out, the rest goes by weight."""
    out = {n: 0 for n in children}
    left, rest = dict((n, wc) for n, wc in children.items() if wc[0] > 0), budget
    while left:
        total = sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if c * total <= w * rest]
        if not full:
            for n, (w, c) in left.items():
                out[n] = rest * w // total
            spare = rest - sum(out[n] for n in left)
            for n in sorted(left, key=lambda n: (-(rest * left[n][0] % total), n is not None, n))[:spare]:
                out[n] += 1
            break
        for n in full:
            out[n] = left[n][1]
        for n in full:
            rest -= left.pop(n)[1]
    return out


def brute(rows, share, epochs, seed):
    leaf = defaultdict(list)
    for d, t, dom, lang, src in rows:
        leaf[dom, lang, src].append((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    tokens = {k: sum(n for _, n in v) for k, v in leaf.items()}
    weight = lambda level, v: WEIGHTS[level].get(v, 1)
    cap = {k: n * epochs if min(weight(*x) for x in zip(("domain", "lang", "source"), k)) > 0 else 0 for k, n in tokens.items()}
    budget = {(): min(int(sum(tokens.values()) * share), sum(cap.values()))}
    for depth, level in enumerate(("domain", "lang", "source")):
        for parent in [k for k in budget if len(k) == depth]:
            kids = {k[depth] for k in cap if k[:depth] == parent}
            got = shared({n: (weight(level, n), sum(c for k, c in cap.items() if k[: depth + 1] == (*parent, n))) for n in kids}, budget[parent])
            budget |= {(*parent, n): b for n, b in got.items()}
    out = []
    for k, docs in leaf.items():
        full, rest = divmod(budget[k], tokens[k]) if tokens[k] else (0, 0)
        key = lambda d: hashlib.md5(f"{seed}:{full}:{'' if d is None else d}".encode()).hexdigest()
        for d, n in docs:
            before = sum(m for e, m in docs if key(e) < key(d))
            copies = full + (before < rest)
            if copies:
                out.append((d, *k, n, copies))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(7)
    rows = []
    for i in range(600):
        src = "s1" if rng.random() < 0.4 else rng.choice(["s2", "s3", "s4", None])
        rows.append((i, " ".join(["w"] * rng.randint(0, 30)) or rng.choice([None, ""]), rng.choice(["a", "b", "c", None]), rng.choice(["en", "de", "xx", None]), src))
    return [*rows, rows[3], (None, "a b c", "a", "en", "s1"), (None, "d", "a", "en", "s1"), (999, "w " * 20_000, "b", "de", "s2")]


@pytest.mark.parametrize("share,epochs", [(0.5, 2), (1.0, 2), (0.05, 1), (3.0, 2)])
def test_equals_brute_force(spark, share, epochs):
    rows = cases()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, dom string, lang string, source string, copies int").repartition(3)
    got = mixing.select(df, F.col("dom"), WEIGHTS, share=share, most_epochs=epochs, seed=5).drop("__row").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, share, epochs, 5)


def test_mixed_rows_and_empty_table(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string, source string")
    chosen = brute(rows, 1.0, 2, 1)
    got = mixing.mixed(df, F.col("dom"), WEIGHTS, share=1.0, most_epochs=2, seed=1)
    assert got.columns == df.columns and got.count() == sum(r[-1] for r in chosen)
    assert mixing.mixed(df.limit(0), F.col("dom"), WEIGHTS).collect() == []


def test_columns_may_have_any_names(spark):
    rows = [(i, f"w{i} a b", "a", "en", "s1", i, i, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string, source string, __id long, __same long, __copies long, __n long")
    got = mixing.mixed(df, F.col("dom"), WEIGHTS, share=1.0)
    assert got.columns == df.columns and sorted(got.collect()) == sorted(df.collect())
