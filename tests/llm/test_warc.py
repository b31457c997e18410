"""WARC round trip, revisits and the merged index."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from sparsegrad.llm import queries, warc


def plain(pages):
    first = {}
    for i, html in pages:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, html in pages:
        b = (html or "").encode()
        refers = first.get(b) if first.get(b) != i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def result(rows):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def in_order(rows):
    rows = sorted(rows, key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows)))
    keys = [(r.url_key, r.capture_time, r.page_id is not None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys)


def test_whole_table(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = queries.warc_index(spark, sf).collect()
    assert result(rows) == plain(pages)
    in_order(rows)


def test_edges_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    monkeypatch.setattr(warc, "RUN_ROWS", 30)
    body = "<p>" + "é" * 60 + "\r\n\r\nWARC/1.1\r\n</p>"
    pages = [(i, "http://www.a.example/hot" if i % 3 else f"https://b{i % 7}.example:8443/x?q={i}#f", body if i % 2 else f"{body}{i}")
             for i in range(300)]
    pages += [(900, None, None), (901, "odd\r\nurl", ""), (902, "http://[bad", "x" * 99), (903, "", "x" * 99),
              (None, "http://c.example", body), (904, "http://d.example", "y" * 300_000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, first int")
    rows = warc.archive(df).collect()
    assert result(rows) == plain([(i, h) for i, _, h in pages])
    in_order(rows)
    assert sum(r.url_key == "example,a)/hot" for r in rows) == 200
    assert warc.archive(df.limit(0)).count() == 0


def test_files_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "LONG_BYTES", 5000)
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    pages = [(i, f"http://h{i % 3}.example/{'u' * 9000 if i == 7 else i}", ("x" if i % 10 else "y" * 30_000) + str(i)) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "a"))
    sizes = [f.stat().st_size for f in (tmp_path / "a").rglob("part-*")]
    assert max(sizes) < 120_000 and len(sizes) >= 8
    assert result(warc.merged_index(warc.read_runs(spark, str(tmp_path / "a"))).collect()) == plain([(i, h) for i, _, h in pages])


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "z" * 200)], "page_id long, url string, html string")
    content = (warc.records(df).first()[0] + warc.END).encode()
    assert next(warc.parse(content))["payload_bytes"] == 200
    for bad in (content.replace(b"zz", b"zy", 1), content[:-3], b"junk" + content):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in range(9):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 12)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.Example.com:443/a?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("http://x.example.org") == "org,example,x)/"
    assert warc.url_key(None) == "" and warc.url_key("not a url") == "not a url"
