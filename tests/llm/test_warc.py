"""WARC round trips, byte ranges against a sequential scan, revisits."""

import gzip
import hashlib
import io
import random

import duckdb
import pytest

from trackml.llm import queries, warc

PAGES = "page_id long, url string, html string"


def test_sf001_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view pages as from '{sf}/pages.parquet'")
    got = {tuple(r) for r in queries.op1_warc(spark, sf).collect()}
    assert got == set(duckdb.sql(queries.SQL["op1_warc"]).fetchall())


def round_trip(spark, rows, tmp_dir, split, **more):
    df = spark.createDataFrame(rows, PAGES)
    for name, value in more.items():
        df = df.selectExpr("*", f"{value} as {name}")
    manifest = warc.write_warc(df.repartition(3), f"file://{tmp_dir}/w")
    out = warc.read_warc(manifest, split_bytes=split).collect()
    assert sum(r.records for r in manifest.collect()) == len(rows)
    return out


@pytest.mark.parametrize("split", [37, 1000, 1 << 22])
def test_every_record_once_at_any_split(spark, tmp_dir, split):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abc <>&é\n") for _ in range(40000))
    rows = [(i, f"http://h/{i}", rnd.choice(["", "x", long[:rnd.randrange(3000)]]))
            for i in range(60)] + [(99, "http://long", long)]
    out = round_trip(spark, rows, tmp_dir, split, payload="'c'", digest="1", start="2")
    got = sorted((r.record_id, r.target_uri, bytes(r.payload).decode()) for r in out
                 if r.record_type == "response")
    assert len(out) == len(rows)
    assert {r.record_id for r in out} == {f"<urn:page:{i}>" for i, _, _ in rows}
    text = {f"<urn:page:{i}>": (u, h) for i, u, h in rows}
    assert all(text[i] == (u, h) for i, u, h in got)


def test_edge_cases(spark, tmp_dir):
    same, short = "s" * 100, "s" * 99
    rows = [(5, "u", same), (3, "u", same), (3, "u", same), (None, "u", same), (7, None, None),
            (8, "a\r\nWARC-Type: x", ""), (1, "u", short), (2, "u", short), (None, None, None)]
    out = round_trip(spark, rows, tmp_dir, 1 << 20)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_length) for r in out),
                 key=str)
    first = "<urn:page:3>"
    assert got == sorted([
        ("<urn:page:5>", "revisit", first, 100), (first, "response", None, 100),
        (first, "response", None, 100), ("<urn:page:>", "revisit", first, 100),
        ("<urn:page:7>", "response", None, 0), ("<urn:page:8>", "response", None, 0),
        ("<urn:page:1>", "response", None, 99), ("<urn:page:2>", "response", None, 99),
        ("<urn:page:>", "response", None, 0)], key=str)
    assert sum(r.record_type == "revisit" for r in out) == 2
    assert all(r.refers_to == first for r in out if r.record_type == "revisit")
    assert all(r.payload_digest == "sha256:" + hashlib.sha256(
        (same if r.payload_length == 100 else short if r.payload_length == 99 else "")
        .encode()).hexdigest() for r in out)


def test_empty_table(spark, tmp_dir):
    assert round_trip(spark, [], tmp_dir, 100) == []


def test_reader_skips_what_is_no_record():
    """Junk, plain gzip members and a stored nested magic are no records."""
    one = warc.record("response", 1, "u", b"\x1f\x8b\x08" * 50, "d", None)
    two = warc.record("response", 2, "u", b"plain", "d", None)
    data = b"junk\x1f\x8b\x08\x00junk" + one + gzip.compress(b"no record") + two + b"\x1f\x8b"
    want = [(i, f["warc-record-id"], b) for i, f, b in warc.records(io.BytesIO(data), 0, len(data))]
    assert [w[1] for w in want] == ["<urn:page:1>", "<urn:page:2>"]
    assert want[0][2] == b"\x1f\x8b\x08" * 50
    for size in (1, 7, 64):
        got = [(i, f["warc-record-id"], b) for s in range(0, len(data), size)
               for i, f, b in warc.records(io.BytesIO(data), s, min(len(data), s + size))]
        assert got == want


def test_cut_off_archive_fails():
    data = warc.record("response", 1, "u", bytes(range(256)) * 40, "d", None)[:-20]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data), 0, len(data)))


def test_listing_by_folder(spark, tmp_dir):
    warc.write_warc(spark.createDataFrame([(1, "u", "x")], PAGES), f"file://{tmp_dir}/w")
    files = warc.archives(spark, f"file://{tmp_dir}/w")
    assert [bytes(r.payload) for r in warc.read_warc(files).collect()] == [b"x"]


def _member(fields, block):
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return gzip.compress(f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()
                         + block + b"\r\n\r\n")


def test_archive_of_http_traffic(spark, tmp_dir):
    """An archive as crawlers write it: heads inside the block, SHA-1 in base 32."""
    import base64

    body = "<p>é</p>".encode() * 50
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    kind = {"Content-Type": "application/http; msgtype=response"}
    members = [
        ({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:0>",
          "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        ({"WARC-Type": "request", "WARC-Record-ID": "<urn:uuid:1>",
          "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"),
        ({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:2>",
          "WARC-Payload-Digest": f"sha1:{sha1}", **kind}, http),
        ({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:3>", "WARC-Payload-Digest":
          "sha256:" + hashlib.sha256(body).hexdigest(), **kind}, http),
        ({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:4>",
          "WARC-Payload-Digest": "sha256:" + "0" * 64, **kind}, http),
        ({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:5>",
          "WARC-Payload-Digest": "blake3:xyz", **kind}, b"HTTP/1.0 404 Not Found\r\n\r\n"),
        ({"WARC-Type": "resource", "WARC-Record-ID": "<urn:uuid:6>"}, body)]
    data = b"".join(_member(*m) for m in members)
    with open(f"{tmp_dir}/crawl.warc.gz", "wb") as f:
        f.write(data)
    for split in (None, 200):
        got = {r.record_id[-2]: r for r in warc.read_warc(
            warc.archives(spark, f"file://{tmp_dir}"), split).collect()}
        assert len(got) == len(members)
        assert [got[k].http_status for k in "0123456"] == [None, None, 200, 200, 200, 404, None]
        assert [got[k].digest_ok for k in "0123456"] == [None, None, True, True, False, None, None]
        assert all(bytes(got[k].payload) == body for k in "2346")
        assert bytes(got["5"].payload) == b"" == bytes(got["1"].payload)
        assert got["4"].payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
        assert got["4"].stated_digest == "sha256:" + "0" * 64


@pytest.mark.parametrize("stated,want", [
    ("md5:" + hashlib.md5(b"x").hexdigest(), True), ("SHA-1:" + hashlib.sha1(b"x").hexdigest(), True),
    ("sha1:" + hashlib.sha1(b"y").hexdigest(), False), ("sha1:!!", None), ("sha1:", None), ("x", None)])
def test_digest_forms(stated, want):
    assert warc.digest_agrees(stated, b"x") is want


def test_split_size_follows_the_total():
    assert warc.split_size(0) == warc.LEAST_SPLIT
    assert warc.split_size(100 << 40) == warc.MOST_SPLIT
    assert warc.LEAST_SPLIT < warc.split_size(100 << 30) < warc.MOST_SPLIT
