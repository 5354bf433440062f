import base64
import hashlib
import random

from gossamer.llm import _store, warc


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h in rows:
        raw, f = (h or "").encode(), first.get(h or "")
        again = f is not None and f != p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    pages = [(i, rng.choice(["http://b.example.com/x", "https://www.a.example.org/p?b=2&a=1", "http://c.example/", None, "not a url", "http://[bad"]) if i % 3 else f"http://h{i}.example.net/é {i}", rng.choice(["<html>same</html>", "", None, f"<p>{i}</p>"])) for i in range(300)]
    return [*pages, (5, "http://x/", pages[5][2]), (None, "http://n/", "<p>only null</p>"), (None, "http://n/", "<html>same</html>"), (900, "http://long/", "long \r\n\r\n page " * 20_000)]


def test_archives_read_back(spark, monkeypatch):
    # Small archives and a small fan-in: many runs, merged in several passes.
    monkeypatch.setattr(warc, "ARCHIVE", 2000)
    monkeypatch.setattr(warc, "FAN_IN", 4)
    rows = cases()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string").repartition(3)
    folder = _store.new_path(spark, "warc")
    runs = warc.write(df, folder)
    indexed = warc.index(runs, folder)
    got = warc.records(indexed).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    by_page = {}
    for p, _, h in rows:
        by_page.setdefault(p, set()).add((h or "").encode())
    assert all(bytes(r.payload) in by_page[r.page_id] for r in got if r.record_type == "response")
    # The index is in order from file to file.
    files = [r.path for r in indexed.orderBy("range").collect()]
    order = [warc.capture_order(c) for f in files for c in warc._slice(f, None, None)]
    assert order == sorted(order) and len(order) == len(rows)


def test_loser_tree():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 30))) for _ in range(n)]
        assert list(warc.merge(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_keys_and_empty_table(spark):
    assert warc.url_key("https://www.Example.com:443/A/B?z=1&a=2#f") == "com,example)/a/b?a=2&z=1"
    assert warc.url_key(None) == ""
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = _store.new_path(spark, "warc")
    assert warc.records(warc.index(warc.write(df, folder), folder)).collect() == []
