"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Of each template's k-word hashes the least of every `WINDOW` in a row go into an inverted index (hash to template and
position), so that any run of WINDOW + K - 1 template words holds an indexed one. Documents are streamed once: their
k-word hashes that the index knows give (template, diagonal) points; points on neighbouring diagonals make a candidate,
which a local alignment within a band around them settles. Reported are the template's share of matched words and the
span in the document, in code points.

Words are lower-cased (A-Z) runs of ASCII letters, digits and bytes of other scripts. Overlapping finds of one template
give the one with most matched words, the earlier at a tie; finds of different templates may overlap.

Defined cases: null and empty texts and templates without K words find nothing; repeated rows are reported each; an
empty table gives no rows; a null doc_id is reported as null; very long texts are scanned whole; other columns than doc_id
and text are not read. The templates are a parameter held by every task; they do not grow with the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gossamer.llm import _text

K, WINDOW = 3, 3
LEAST_COVERAGE = 0.8
FOUND = "doc_id long, license string, start int, stop int, n_matched int, n_words int, coverage double"
U = np.uint64


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash (the last of equals) of every `window` in a row."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(rows)) + window - 1 - np.argmin(rows[:, ::-1], axis=1))


def align(t: np.ndarray, d: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Local alignment of template words t with document words d, position j of d at most `band` off i + diagonal:
    number of matched words and the span of d (from, to). A match counts 2, anything else -1."""
    width = 2 * band + 1
    lane, low = np.arange(width), diagonal - band
    # Document words by place in the band: row i looks at those from i to i + width.
    place = np.arange(len(t) + width) + low
    there = (place >= 0) & (place < len(d))
    words = d[np.clip(place, 0, max(len(d) - 1, 0))] if len(d) else np.zeros(len(place), d.dtype)
    # Of each cell the score, matched words and where its alignment begins.
    score, matched, begin = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1)
    best = (0, 0, 0, 0)
    for i in range(len(t)):
        inside, j = there[i : i + width], place[i : i + width]
        same = inside & (words[i : i + width] == t[i])
        s, m, a = np.where(same, score + 2, score - 1), matched + same, np.where(same & (begin < 0), j, begin)
        # A template word left out: from the cell to the right, one row up.
        skip = np.flatnonzero(score[1:] - 1 > s[:-1])
        s[skip], m[skip], a[skip] = score[skip + 1] - 1, matched[skip + 1], begin[skip + 1]
        s[~inside | (s <= 0)] = 0
        # Document words left out: the cell to the left that is best after what each step costs, the nearest of equals.
        ahead = s + lane
        source = np.maximum.accumulate(np.where(ahead >= np.maximum.accumulate(ahead), lane, 0))
        score = s[source] - (lane - source)
        score[~inside] = 0
        none = score <= 0
        score[none] = 0
        matched, begin = np.where(none, 0, m[source]), np.where(none, -1, a[source])
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), int(matched[k]), int(begin[k]), int(j[k]) + 1)
    return best[1:]


class Index:
    """The templates' words and the inverted index of their winnowed fingerprints."""

    def __init__(self, templates: dict[str, str], k: int = K, window: int = WINDOW):
        self.k, self.names, self.words, pairs = k, [], [], []
        for name, text in templates.items():
            data, off = _text.buffers(pa.array([text]))
            _, _, h, first = _text.words(data, off, _text.NON_WORD)
            if len(h) < k:
                continue
            grams, _ = _text.shingles(h, first, k)
            pairs += [(int(grams[p]), len(self.names), int(p)) for p in winnow(grams, window)]
            self.names.append(name)
            self.words.append(h)
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], U)
        self.template, self.position = np.array([p[1] for p in pairs], int), np.array([p[2] for p in pairs], int)
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.keys >> U(48)).astype(np.int64)] = True

    def find(self, data: np.ndarray, off: np.ndarray, least: float = LEAST_COVERAGE):
        """(row, template, from, to, matched) with from and to in bytes of the row."""
        starts, ends, h, first = _text.words(data, off, _text.NON_WORD)
        grams, at = _text.shingles(h, first, self.k)
        near = np.flatnonzero(self.gate[(grams >> U(48)).astype(np.int64)])
        left, right = np.searchsorted(self.keys, grams[near], "left"), np.searchsorted(self.keys, grams[near], "right")
        hits: dict[tuple[int, int], list[int]] = {}
        for g, a, b in zip(near[right > left], left[right > left], right[right > left]):
            r = int(np.searchsorted(at, g, "right")) - 1
            for j in range(a, b):
                hits.setdefault((r, int(self.template[j])), []).append(int(g - at[r]) - int(self.position[j]))
        for (r, t), diagonals in sorted(hits.items()):
            template, mine = self.words[t], h[first[r] : first[r + 1]]
            slack, diagonals, found, i = 4 + len(template) // 8, sorted(diagonals), set(), 0
            while i < len(diagonals):
                j = i
                while j + 1 < len(diagonals) and diagonals[j + 1] - diagonals[j] <= slack and diagonals[j + 1] - diagonals[i] <= len(template):
                    j += 1
                middle = (diagonals[i] + diagonals[j]) // 2
                found.add(align(template, mine, middle, (diagonals[j] - diagonals[i]) // 2 + slack))
                i = j + 1
            last = []
            for matched, a, b in sorted(found, key=lambda x: (-x[0], x[1])):
                if matched >= least * len(template) and all(b <= x or a >= y for x, y in last):
                    last.append((a, b))
                    yield r, t, int(starts[first[r] + a] - off[r]), int(ends[first[r] + b - 1] - off[r]), matched


def scan(docs: DataFrame, templates: dict[str, str], least: float = LEAST_COVERAGE) -> DataFrame:
    """Rows (doc_id, license, start, stop, n_matched, n_words, coverage) of the finds that reach `least`."""
    index = Index(templates)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, _, data, off in _text.text_pieces(batch, "text"):
                # Code points before a byte: bytes that do not continue a character.
                out = []
                for r, t, x, y, n in index.find(data, off, least):
                    row = data[off[r] : off[r + 1]]
                    heads = (row[:y] & 0xC0) != 0x80
                    size = len(index.words[t])
                    out.append((ids[a + r], index.names[t], int(heads[:x].sum()), int(heads.sum()), n, size, n / size))
                if out:
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)
