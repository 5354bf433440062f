import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from gossamer.llm import tiff

RNG = np.random.default_rng(3)
IMAGES = [RNG.integers(0, 256, (37, 50), np.uint8), np.zeros((5, 3), np.uint8), RNG.integers(0, 3, (64, 33, 3), np.uint8), np.arange(9000, dtype=np.uint8).reshape(90, 100)]


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("how", [{}, {"rows_per_strip": 7}, {"tile": (16, 32)}])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(scheme, predictor, how, order):
    pages = list(tiff.decode(tiff.encode(IMAGES, scheme, predictor, order=order, **how)))
    assert len(pages) == len(IMAGES)
    for (_, a), image in zip(pages, IMAGES):
        assert np.array_equal(a, image if image.ndim == 3 else image[:, :, None])


def test_lzw_of_long_data_passes_every_code_width():
    rng = random.Random(1)
    for raw in (bytes(rng.choices(range(256), k=60_000)), b"ab" * 40_000, b"\0" * 100_000, b"", b"x"):
        assert tiff.un_lzw(tiff.lzw(raw), len(raw)) == raw
        assert tiff.unpack_bits(tiff.pack_bits(raw), len(raw)) == raw


def test_bits_below_a_byte_and_wider_samples():
    def one(bits, samples, raw, w, h, more=()):
        fields = sorted([(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, 1), (273, 4, 8), (277, 3, samples), (278, 4, h), (279, 4, len(raw)), *more])
        body = raw + b"\0" * (len(raw) % 2)
        head = b"II" + struct.pack("<HI", 42, 8 + len(body))
        return head + body + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I", v) for t, k, v in fields) + b"\0\0\0\0"

    (_, a), *_ = tiff.decode(one(1, 1, bytes([0b10110000, 0b01000000]), 4, 2))
    assert a[:, :, 0].tolist() == [[1, 0, 1, 1], [0, 1, 0, 0]]
    (_, a), *_ = tiff.decode(one(16, 1, struct.pack("<4H", 1, 2, 3, 60000), 2, 2))
    assert a[:, :, 0].tolist() == [[1, 2], [3, 60000]]
    (_, a), *_ = tiff.decode(one(16, 1, struct.pack("<4H", 1, 2, 3, 60000), 2, 2, [(317, 3, 2)]))
    assert a[:, :, 0].tolist() == [[1, 3], [3, 60003]]


@pytest.mark.parametrize("data,error", [(None, "empty"), (b"", "empty"), (b"JFIF....", "no TIFF header"), (b"II*\0\xff\xff\0\0", "a directory lies outside the file")])
def test_errors_are_rows(data, error):
    assert [r[-1] for r in tiff.page_rows(data)] == [error]


def test_a_ring_of_directories_ends():
    raw = bytearray(tiff.encode([IMAGES[1], IMAGES[1]]))
    first = struct.unpack_from("<I", raw, 4)[0]
    n = struct.unpack_from("<H", raw, first)[0]
    second = struct.unpack_from("<I", raw, first + 2 + 12 * n)[0]
    struct.pack_into("<I", raw, second + 2 + 12 * n, first)
    rows = list(tiff.page_rows(bytes(raw)))
    assert [r[-1] for r in rows] == [None, None, "the directories form a ring"]


def test_digests_of_texts(spark):
    from pyspark.sql import functions as F

    texts = [(1, "hello"), (2, ""), (3, None), (4, "é" * 32), (5, "x" * 64), (6, "hello"), (7, "long text " * 20_000), (None, "hello")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in texts], "doc_id long, text string, pixels string")
    media = tiff.with_media(docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))).select("doc_id", "n_bytes", "media")
    got = tiff.digests(media).collect()
    assert len(got) == len(texts)
    features = {}
    for r in got:
        t = next((t for d, t in texts if d == r.doc_id), "hello")
        raw = (t or "").encode()
        pad = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        features.setdefault(t, set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in features.values())
    assert tiff.digests(media.limit(0)).collect() == []


def test_pages_of_a_table(spark):
    rows = [(1, bytearray(tiff.encode(IMAGES)), "a"), (2, None, "b"), (3, bytearray(b"nonsense"), "c")]
    df = spark.createDataFrame(rows, "doc_id long, media binary, width string")
    got = sorted(tiff.pages(df, "media", ["doc_id", "width"]).collect(), key=lambda r: (r.doc_id, r.page))
    assert [(r.doc_id, r.page, r.error) for r in got] == [(1, 0, None), (1, 1, None), (1, 2, None), (1, 3, None), (2, 0, "empty"), (3, 0, "no TIFF header")]
    assert bytes(got[0].pixels) == IMAGES[0].tobytes() and got[0].width == 50


def test_broken_and_boasting_files_are_rows_with_an_error(spark):
    import struct

    good = tiff.encode([np.zeros((4, 64), np.uint8)])
    at = struct.unpack_from("<I", good, 4)[0]
    boasting = bytearray(good)
    for k in range(struct.unpack_from("<H", good, at)[0]):
        if struct.unpack_from("<H", good, at + 2 + 12 * k)[0] in (tiff.WIDTH, tiff.HEIGHT):
            struct.pack_into("<I", boasting, at + 2 + 12 * k + 8, 0xFFFFFFFF)
    files = [bytes(boasting), b"no tiff at all", good[:20], None, b"", good]
    for f in files[:-1]:
        [row] = tiff.page_rows(f)
        assert row[-1] and row[8] is None
    df = spark.createDataFrame([(i, 0, f) for i, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in tiff.digests(df).collect()}
    assert len(got) == len(files) and all((got[i].payload_bytes is None) == (i < 5) and got[i].feature.startswith("error") == (i < 5) for i in got)
