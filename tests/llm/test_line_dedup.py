import hashlib
import random
from collections import defaultdict

import pytest

from gossamer.llm import line_dedup

BLANK = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, least=20, docs=3):
    holders = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and len(holders.get(key(x), ())) >= docs and max(holders[key(x)]) != d for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(2)
    shared = [f"this line number {i} is shared by several" for i in range(6)] + ["é" * 19, "É" * 20, "short", "  Padded LINE of twenty chars and more \t"]
    rows = [(i, "\n".join(rng.choice(shared) if rng.random() < 0.4 else f"own line {i} {j} with some more text" for j in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, shared[0]), (None, None), (5, rows[5][1]), (6, shared[1] + "\nother"), (300, (shared[2] + "\n") * 400), (301, shared[2].upper() + "\r\n" + shared[2] + "\x0b")]
    # One line in all of many documents: it fills several partitions.
    rows += [(1000 + i, f"{shared[0]}\nunique text of document number {i}\n{shared[0].upper()}") for i in range(400)]
    return rows


@pytest.mark.parametrize("held", [20_000, 7])
def test_equals_brute_force(spark, held, monkeypatch):
    # Few held rows make runs that are too long to hold.
    monkeypatch.setattr(line_dedup, "HELD", held)
    rows = cases()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, positions string, open int").repartition(5)
    got = line_dedup.kept_digests(df, line_dedup.keep_bitmaps(df)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_texts_and_empty_table(spark):
    rows = cases()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, dropped string")
    bitmaps = line_dedup.keep_bitmaps(df)
    want = {(d, h) for d, _, _, h in brute(rows)}
    got = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in line_dedup.kept_texts(df, bitmaps).collect()}
    assert got == want
    none = df.limit(0)
    assert line_dedup.kept_digests(none, line_dedup.keep_bitmaps(none)).collect() == []
