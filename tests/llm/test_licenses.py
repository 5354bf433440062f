import random

import pyarrow as pa

from gossamer.llm import _text, licenses
from gossamer.llm.license_texts import TEMPLATES


def longest_common(a, b):
    """Words of a matched in order within the best window of b, by plain dynamic programming over all pairs."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def hashes(text):
    data, off = _text.buffers(pa.array([text]))
    return _text.words(data, off, _text.NON_WORD)[2].tolist()


def cases():
    rng = random.Random(6)
    names = list(TEMPLATES)
    filler = lambda n: " ".join(rng.choices(["lorem", "ipsum", "the", "software", "license", "é", "permission"], k=n))
    rows = [(i, f"{filler(rng.randint(0, 40))}\n{TEMPLATES[names[i % len(names)]]}\n{filler(10)}") for i in range(len(names))]
    for i, n in enumerate(names):
        w = TEMPLATES[n].split()
        if len(w) > 20:
            for _ in range(3):
                w[rng.randrange(len(w))] = "altered"
            del w[10]
            rows.append((100 + i, f"é {filler(5)} {' '.join(w).upper()} {filler(5)}"))
    rows += [(200, None), (201, ""), (202, filler(500)), (None, TEMPLATES["MIT-notice"]), (203, "x " * 50_000 + TEMPLATES["GPL-3.0-notice"]), (204, TEMPLATES["MIT-notice"] + " and " + TEMPLATES["MIT-notice"])]
    return rows


def test_finds_what_full_alignment_finds(spark):
    rows = cases()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, license string")
    got = licenses.scan(df, TEMPLATES).collect()
    found = {(r.doc_id, r.license) for r in got}
    templates = {n: hashes(t) for n, t in TEMPLATES.items()}
    for d, t in rows:
        w = hashes(t or "")
        if len(w) > 2000:
            assert (d, "GPL-3.0-notice") in found
            continue
        for n, x in templates.items():
            share = longest_common(x, w) / len(x)
            if share < licenses.LEAST_COVERAGE:
                assert (d, n) not in found
            if t and TEMPLATES[n] in t:
                assert (d, n) in found
    texts = dict(rows)
    for r in got:
        span = texts[r.doc_id][r.start : r.stop]
        assert longest_common(templates[r.license], hashes(span)) >= r.n_matched and r.coverage == r.n_matched / r.n_words
    assert sum((r.doc_id, r.license) == (204, "MIT-notice") for r in got) == 2
    assert all((100 + i, n) in found for i, n in enumerate(TEMPLATES) if len(TEMPLATES[n].split()) > 40)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), TEMPLATES).collect() == []


def test_winnowing_keeps_one_of_every_window():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 1 << 60, 200).astype(np.uint64)
    picked = set(licenses.winnow(h, 4).tolist())
    assert all(picked & set(range(i, i + 4)) for i in range(197))


def plain_align(t, d, diagonal, band):
    """Cell by cell."""
    width, best = 2 * band + 1, (0, 0, 0, 0)
    before = [(0, 0, -1)] * width
    for i, x in enumerate(t):
        row = []
        for b in range(width):
            j = i + diagonal + b - band
            if not 0 <= j < len(d):
                row.append((0, 0, -1))
                continue
            s, m, a = before[b]
            cell = (s + 2, m + 1, j if a < 0 else a) if x == d[j] else (s - 1, m, a)
            for s, m, a in ([before[b + 1]] if b + 1 < width else []) + ([row[-1]] if b else []):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, a)
            row.append(cell if cell[0] > 0 else (0, 0, -1))
            if cell[0] > best[0]:
                best = (*cell, j + 1)
        before = row
    return best[1:]


def test_alignment_by_rows_equals_alignment_by_cells():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        t, d = (rng.integers(0, 4, rng.integers(1, n)).astype(np.uint64) for n in (15, 40))
        diagonal, band = int(rng.integers(-10, 40)), int(rng.integers(0, 12))
        assert licenses.align(t, d, diagonal, band) == plain_align(t, d, diagonal, band)
