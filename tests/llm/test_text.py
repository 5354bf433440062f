import re

import numpy as np
import pyarrow as pa

from gossamer.llm import _text

TEXTS = ["Hello World a", "", None, "  x\ny\tz é  ", "one two three four five six", "A", "\x0b\x0c a\r\nB", "日本 語 " * 50, "word " * 3000]


def test_words_are_those_of_the_pattern():
    data, off = _text.buffers(pa.array(TEXTS))
    starts, ends, h, first = _text.words(data, off)
    for i, t in enumerate(TEXTS):
        want = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        assert [bytes(data[a:b]) for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == want
    by_word = {}
    for k in range(len(starts)):
        by_word.setdefault(bytes(data[starts[k] : ends[k]]).lower(), set()).add(int(h[k]))
    assert all(len(v) == 1 for v in by_word.values()) and len(set().union(*by_word.values())) == len(by_word)


def test_pieces_cover_all_rows_and_shingles_keep_short_rows():
    batch = pa.record_batch([pa.array(TEXTS)], ["text"])
    seen = []
    for a, b, data, off in _text.text_pieces(batch, "text", most=100):
        seen += range(a, b)
        _, _, h, first = _text.words(data, off)
        sh, at = _text.shingles(h, first, 4)
        for i in range(b - a):
            n = first[i + 1] - first[i]
            assert at[i + 1] - at[i] == (n - 3 if n >= 4 else min(n, 1))
    assert seen == list(range(len(TEXTS)))


def test_sliced_columns():
    whole = pa.array(TEXTS)
    data, off = _text.buffers(whole.slice(3, 2))
    assert bytes(data[off[0] : off[1]]).decode() == TEXTS[3] and bytes(data[off[1] : off[2]]).decode() == TEXTS[4]
    assert len(_text.buffers(pa.array([], pa.string()))[1]) == 1
    assert np.array_equal(_text.buffers(pa.array([None, None], pa.string()))[1], [0, 0, 0])
