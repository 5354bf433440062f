import random
import zlib

import numpy as np
import pytest

from gossamer.llm import _store, wavelet

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", ".", "'", "1", "é", "　", " ", "the", "'s", "…", "日本", "<|endoftext|>", "\r\n", "-", "«"]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000)]
    return [*out, "", "word " * 30_000, "Same. Same! same, (same) same's"]


def test_ids_are_the_tokenizers_own():
    e = wavelet.Encoder(PATH)
    ts = texts()
    want = [x.ids for x in e.tokenizer.encode_batch(ts, add_special_tokens=False)]
    assert [x.tolist() for x in e.ids(ts)] == want
    # Known pieces, and a table that has to be emptied, give the same.
    e.MOST = 500
    assert [x.tolist() for i in range(0, len(ts), 300) for x in e.ids(ts[i : i + 300])] == want


def test_a_text_with_more_pieces_than_are_remembered():
    e = wavelet.Encoder(PATH)
    e.MOST = 50
    ts = ["some known words", " ".join(f"word{i}" for i in range(400)), "some known words and more", " ".join(f"word{i}" for i in range(399, 0, -1))]
    for t in ts:
        assert e.ids([t])[0].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert sum(len(x[0]) for x in e.tables) <= e.MOST


@pytest.mark.parametrize("ids", [np.random.default_rng(0).integers(0, 50257, 30_000).astype(np.uint16), np.zeros(1000, np.uint16), np.array([7], np.uint16), np.random.default_rng(1).integers(0, 200_000, 5000).astype(np.uint32)])
def test_access_rank_select(ids):
    m = wavelet.WaveletMatrix(wavelet.dump(ids, [3], np.array([len(ids)])))
    assert (m.ids() == ids).all() and m.doc_ids == [3]
    rng = random.Random(0)
    for i in rng.sample(range(len(ids)), min(len(ids), 60)):
        assert m.access(i) == ids[i]
        t = int(ids[i])
        assert m.rank(t, i) == (ids[:i] == t).sum() and m.select(t, m.rank(t, i)) == i and m.count(t) == (ids == t).sum()
    assert m.count(1 << 20) == 0
    with pytest.raises(IndexError):
        m.access(len(ids))


@pytest.mark.parametrize("shard", [wavelet.SHARD, 500])
def test_files_hold_the_documents_in_order(spark, shard):
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts()[-101:])] + [(500, None), (501, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(5)
    manifest = wavelet.write(df, PATH, _store.new_path(spark, "test"), shard=shard)
    got = sorted(wavelet.read(manifest).collect(), key=lambda r: r.start)
    e, start = wavelet.Encoder(PATH), 0
    for r, (d, t) in zip(got, sorted(rows), strict=True):
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_table_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert wavelet.read(wavelet.write(none, PATH, _store.new_path(spark, "test"))).collect() == []
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "a")], "doc_id long, text string")
    got = sorted(wavelet.read(wavelet.write(df, PATH, _store.new_path(spark, "test"))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1]
