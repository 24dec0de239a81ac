import gzip
import hashlib
import io
import random

import pytest

from gridloom.llm import warc as W


def pages_of(spark, rows, columns="page_id long, url string, html string"):
    return spark.createDataFrame(rows, columns)


def brute(rows):
    kept = {}
    for page, _, html in rows:
        html = html or ""
        if len(html.encode()) >= 1000 and page is not None:
            kept[html] = max(kept.get(html, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = kept.get(html or "")
        revisit = top is not None and page != top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    rng = random.Random(1)
    bodies = ["x" * 999, "x" * 1000, "é" * 500, "é" * 499 + "a", "<p>" + "hot " * 400, "", None, "\r\n\r\nWARC/1.1\r\n" * 90]
    rows = [(i, f"http://h/{i}", rng.choice([*bodies, bodies[4], f"page {i} " * 200])) for i in range(300)]
    rows += [(1000, None, bodies[1]), (1001, "http://x\r\ny: z", bodies[1]), (-5, "", "b" * 200_000)]
    got = W.archive_pages(pages_of(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_edges(spark):
    assert W.archive_pages(pages_of(spark, [])).count() == 0
    body = "z" * 2000
    rows = [(7, "u", body), (7, "u", body), (None, "u", body), (3, "u", body)]
    got = sorted((tuple(r) for r in W.archive_pages(pages_of(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert W.archive_pages(pages_of(spark, [(1, "u", "h", "p")], "page_id long, url string, html string, payload string")).count() == 1


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives(spark, tmp_path, compression):
    rows = [(i, f"http://h/{i}", ("text %d " % i) * (1 if i % 2 else 300)) for i in range(40)] + [(100, "http://again", "text 2 " * 300)]
    path = str(tmp_path / "w")
    W.write_archives(W.page_records(pages_of(spark, rows)), path, compression)
    every = W.read_archives(spark, path)
    assert every.count() == 41
    one = every.where("target_uri = 'http://h/4'").first()
    assert bytes(one["payload"]).decode() == rows[4][2] and one["headers"]["warc-type"] == "response" and one["record_id"] == "<urn:page:4>"
    again = every.where("record_type = 'revisit'").collect()
    assert [(r["record_id"], r["refers_to"], bytes(r["payload"])) for r in again] == [("<urn:page:2>", "<urn:page:100>", b"")]
    files = [f for f in tmp_path.glob("w/*") if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".warc.gz") == (compression == "gzip") for f in files)
    if compression == "gzip":  # any gzip reader sees whole records
        assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") for f in files) == 41
    (tmp_path / "w" / "part-lost.warc").write_bytes(b"half a rec")  # of a task that did not commit
    assert W.read_archives(spark, path).count() == 41


def test_filters_are_pushed_and_payloads_left_alone(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", "body " * 300 + str(i)) for i in range(10)]
    path = str(tmp_path / "w")
    W.write_archives(W.page_records(pages_of(spark, rows)), path)
    few = W.read_archives(spark, path, "record_type string, target_uri string").where("record_type = 'response' and target_uri in ('http://h/1', 'http://h/2')")
    assert few.count() == 2
    assert "Filter" not in few._jdf.queryExecution().optimizedPlan().toString().replace("PushedFilters", "")
    data = b"".join(f.read_bytes() for f in tmp_path.glob("w/part-*"))
    inflated = []
    real = W.zlib.decompressobj

    class Spy:
        def __init__(self, bits):
            self.inner = real(bits)

        def decompress(self, data, most=0):
            out = self.inner.decompress(data, most)
            inflated.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(W.zlib, "decompressobj", Spy)
    assert list(W.records(io.BytesIO(data), lambda h: False, True)) == []
    assert len(inflated) == 10


def foreign():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a\r\n b\r\nContent-Length: 3\r\n\r\n\xff\x00x\r\n\r\n"
    return one, two


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_archives_of_others(chunk, monkeypatch):
    monkeypatch.setattr(W._Source, "CHUNK", chunk)
    one, two = foreign()
    for data in (one + two, gzip.compress(one) + gzip.compress(two)):
        got = list(W.records(io.BytesIO(data), lambda h: True, True))
        assert [h["warc-type"] for h, _ in got] == ["warcinfo", "resource"] and [b for _, b in got] == [b"hello", b"\xff\x00x"]
        assert got[1][0]["warc-target-uri"] == "http://a b"
        (only,) = W.records(io.BytesIO(data), lambda h: h["warc-type"] == "resource", False)
        assert only[1] is None
    with pytest.raises((EOFError, ValueError)):
        list(W.records(io.BytesIO(two[:-12]), lambda h: True, True))
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(b"garbage\r\n\r\n"), lambda h: True, True))
