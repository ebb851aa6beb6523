"""WARC records, the capture index, and the round trip."""

import gzip
import hashlib
import io
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.llm import warc as W
from spanloom.llm.queries import ORACLES, QUERIES


def test_surt():
    assert W.surt("http://www.Example.com:80/a/b?q=1#x") == "com,example,www)/a/b?q=1"
    assert W.surt(None) == ")/" and W.surt("example.org") == "org,example)/"


def test_record_round_trip():
    body = "héllo\r\n\r\nWARC/1.1\r\n".encode()
    raw = W.record("urn:page:7", "http://a/\nb", body, hashlib.sha1(body).hexdigest(), None)
    head, payload = W.parse(gzip.decompress(raw))
    assert payload == body and head["warc-target-uri"] == "http://a/%0Ab" and head["warc-record-id"] == "<urn:page:7>"
    many = raw * 3 + W.record("urn:page:8", None, b"", hashlib.sha1(b"").hexdigest(), "urn:page:7")
    for size in (1, 7, 1 << 20):
        found = [W.parse(m) for m in W.members(io.BytesIO(many), size)]
        assert [h["warc-type"] for h, _ in found] == ["response"] * 3 + ["revisit"]


def pages(spark):
    big = "x" * 999
    rows = [(1, "http://b.com/1", big), (2, "http://b.com/1", big), (3, "http://a.com/", big + "é"), (9, "http://a.com/", big + "é"), (5, "http://b.com/1", big + "é"), (6, None, None), (7, "bad url \t", ""), (None, "http://n.com", big + "é"), (9, "http://a.com/", big + "é"), (11, "http://z.com", "long " * 300_000)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("key", F.lit("clash"))


def test_round_trip(spark):
    df = pages(spark).repartition(3)
    written = W.write_archives(df)
    got = sorted(map(tuple, W.read_archives(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for r in df.collect():
        body = (r["html"] or "").encode()
        revisit = len(body) >= 1000 and r["page_id"] in (3, 5)
        want.append((r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=str)
    assert W.read_archives(W.write_archives(df.limit(0))).count() == 0


def test_index_finds_every_capture(spark, monkeypatch):
    monkeypatch.setattr(W, "LINES", 2)
    df = pages(spark).where("page_id is not null").dropDuplicates(["page_id"]).repartition(2)
    written = W.write_archives(df)
    index = W.CaptureIndex(written["index"], [tuple(r) for r in written["parts"].collect()], written["archives"])
    for r in df.collect():
        head, payload = index.read(W.surt(r["url"]), r["page_id"])
        assert head["warc-record-id"] == f"<urn:page:{r['page_id']}>"
        if head["warc-type"] == "response":
            assert payload == (r["html"] or "").encode()
    assert index.read("com,nothing)/", 1) is None and index.read(W.surt("http://a.com/"), 777) is None


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(con.sql(f"select {', '.join(cols)} from ({ORACLES['op6_warc']})").fetchall(), key=str)
    assert sorted(map(tuple, QUERIES["op6_warc"](spark, sf).select(cols).collect()), key=str) == want


def test_reading_goes_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(W, "LINES", 3)
    written = W.write_archives(pages(spark).coalesce(1))
    folder = written["index"].removeprefix("file:")
    name = written["parts"].first()["name"]
    key, at, size = open(f"{folder}/{name}.directory").read().split("\n")[0].rsplit(" ", 2)
    lines = zlib.decompress(open(f"{folder}/{name}.blocks", "rb").read()[int(at) : int(at) + int(size)]).decode().split("\n")

    def put(lines):
        """Makes these the only block of the part."""
        block = zlib.compress("\n".join(lines).encode())
        open(f"{folder}/{name}.blocks", "wb").write(block)
        open(f"{folder}/{name}.directory", "w").write(f"{key} 0 {len(block)}")

    put(lines[1:])
    with pytest.raises(ValueError, match="the index lists"):
        W.read_archives(written)
    everything = written["lines"].select("key", "page_id", "file", "at", "size").collect()
    right = [f"{W.clean(r['key']).replace(' ', '%20')} {'' if r['page_id'] is None else r['page_id']} {r['file']} {r['at']} {r['size']}" for r in everything]
    wrong = right[:-2] + [right[-2].rsplit(" ", 2)[0] + " " + " ".join(right[-1].rsplit(" ", 2)[1:]), right[-1]]
    assert written["parts"].count() == 1
    put(wrong)
    with pytest.raises(Exception, match="where the index has"):
        W.read_archives(written).collect()
    put(right)
    assert W.read_archives(written).count() == len(everything)


@pytest.mark.parametrize("salts, most", [(1, 0), (64, 0), (64, 100_000)])
def test_repeated_ids_with_different_payloads(spark, monkeypatch, salts, most):
    """Id 3 revisits 9 by one payload only, and 9 has another payload, of another size, besides."""
    monkeypatch.setattr(W, "BROADCAST_ROWS", most)
    monkeypatch.setattr(W, "SALTS", salts)
    a, b, c = "a" * 1500, "b" * 2000, "c" * 3000
    rows = [(3, "http://a.com/", a), (3, "http://a.com/", b), (9, "http://a.com/", a), (9, "http://a.com/", c)]
    written = W.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = sorted(map(tuple, W.read_archives(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = [(i, len(x), hashlib.sha1(x.encode()).hexdigest(), "revisit" if r else "response", r) for i, x, r in ((3, a, 9), (3, b, None), (9, a, None), (9, c, None))]
    assert got == sorted(want, key=str)


def test_captures_of_one_url(monkeypatch, tmp_path):
    """Of 100,000 captures of one URL a look-up reads one block, whose place binary searches find."""
    monkeypatch.setattr(W, "LINES", 500)
    import pyarrow as pa

    rows = [("com,one)/", i, "f", i, 1) for i in range(100_000)] + [("com,two)/", None, "f", 0, 1), ("com,two)/", 5, "f", 7, 1)]
    parts = []
    for k in range(0, len(rows), 30_000):
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 30_000])], ["key", "page_id", "file", "at", "size"])
        parts += [(b.column("first")[0].as_py(), b.column("name")[0].as_py()) for b in W._write_index(str(tmp_path))(iter([batch]))]
    index, read = W.CaptureIndex(str(tmp_path), parts, ""), []
    plain = index.entries
    monkeypatch.setattr(index, "entries", lambda *a: read.append(a) or plain(*a))
    for page in (0, 1, 499, 500, 29_999, 30_000, 77_777, 99_999):
        read.clear()
        assert [x[3] for x in index.captures("com,one)/", page)] == [page] and len(read) <= 3
    assert list(index.captures("com,one)/", 100_000)) == [] and [x[3] for x in index.captures("com,two)/")] == [0, 7]
    assert sum(1 for _ in index.captures("com,one)/")) == 100_000


def test_a_busy_payload_and_a_busy_url(spark):
    """Hundreds of copies of one page under one URL: one response, all others revisit it."""
    body = "y" * 1200
    rows = [(i, "http://a.com/", body) for i in range(400)] + [(1000 + i, "http://a.com/", body + str(i)) for i in range(20)]
    got = {r["page_id"]: tuple(r)[1:] for r in W.read_archives(W.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3))).collect()}
    for i, _, html in rows:
        first = i == 399 or i >= 1000
        assert got[i] == (len(html), hashlib.sha1(html.encode()).hexdigest(), "response" if first else "revisit", None if first else 399)
