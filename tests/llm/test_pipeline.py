import os
import zlib

import numpy as np
import pytest
import test_decontaminate
import test_mixing

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def without_copies(rows):
    """The smallest doc_id of each component of documents with a similarity of 0.8 or more."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return [r for r in rows if root(r.doc_id) == r.doc_id]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
def test_every_stage_equals_a_plain_version(spark, monkeypatch):
    import corpus_pipeline
    from gossamer.llm import quality
    from gossamer.llm.queries import WEIGHTS, table, tokenizer_path
    from tokenizers import Tokenizer

    documents = table(spark, FOLDER, "documents")
    rows = documents.collect()
    stages, frames = dict(corpus_pipeline.STAGES), []
    now = documents
    for name, stage in list(stages.items())[:-1]:
        following = stage(spark, now, FOLDER)
        assert following.columns == documents.columns, name
        now = spark.createDataFrame(following.collect(), documents.schema)
        frames.append(sorted(now.collect()))
    last = sorted(stages["token ids"](spark, now, FOLDER).collect())

    model = quality.train(documents, table(spark, FOLDER, "labels"))
    score = lambda t: model.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
    rows = [r for r in rows if score((r.text or "").encode()) >= 0.3]
    assert frames[0] == sorted(rows)
    rows = without_copies(rows)
    assert frames[1] == sorted(rows) and len(frames[1]) < len(frames[0])
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in test_decontaminate.brute([(r.doc_id, r.text) for r in rows], items)}
    rows = [r for r in rows if r.doc_id not in bad]
    assert frames[2] == sorted(rows) and bad
    monkeypatch.setattr(test_mixing, "WEIGHTS", WEIGHTS)
    chosen = {r[0]: r[-1] for r in test_mixing.brute([(r.doc_id, r.text, f"d{int(r.source[3:]) % 3}", r.lang, r.source) for r in rows], 1.0, 2, 1)}
    rows = [r for r in rows for _ in range(chosen.get(r.doc_id, 0))]
    assert frames[3] == sorted(rows)
    encoder, at = Tokenizer.from_file(tokenizer_path()), 0
    for got, r in zip(last, sorted(rows, key=lambda r: r.doc_id), strict=True):
        ids = [*encoder.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert tuple(got) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_rows_pass_through(spark, monkeypatch):
    """Nulls, empty texts, repeated rows, equal ids, columns that operators use themselves; and no rows at all."""
    import corpus_pipeline

    documents = corpus_pipeline.table(spark, FOLDER, "documents")
    names = ["__row", "__id", "__same", "__copies", "__n", "score", "predicted", "domain"]
    odd = [(None, "no id at all"), (None, None), (1, None), (2, ""), (3, "the same words in one row and another"), (3, "the same words in one row and another"), (4, "x " * 30_000)]
    rows = [(d, t, None, "src1", 0, *range(len(names))) for d, t in odd]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names))
    for frame in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, FOLDER)
            got = out.collect()
            if name != "token ids":
                assert out.columns == df.columns and {r.doc_id for r in got} <= {r[0] for r in odd}, name
            else:
                assert len(got) == frame.count()
            if name.startswith(("n-gram", "benchmark")) and frame is df:
                assert sum(r.doc_id is None for r in got) == 2
    assert documents.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
