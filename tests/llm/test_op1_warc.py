import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import warc
from quillspark.llm.common import fresh_path

SCHEMA = "row_id long, url string, payload binary"
BIG = b"x" * 250


def written(spark, rows):
    folder = fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder).collect()
    return folder


def test_round_trip_and_revisits(spark):
    rows = [(3, "http://a/", BIG), (1, "http://b/ c\u00e4", BIG), (2, None, b"small"), (4, "u", b"small"), (5, "u", b""), (None, "u", BIG), (6, "u", bytes(range(256)) * 50)]
    chunks = warc.read_chunks(spark, written(spark, rows), chunk_bytes=1000)
    got = {}
    for r in chunks.orderBy("row_id", "chunk_no").collect():
        got.setdefault(r["row_id"], []).append(r)
    assert len(got) == 7
    by_id = dict((i, p) for i, _, p in rows)
    for i, parts in got.items():
        last, payload = parts[-1], by_id[i]
        assert last["is_last"] and last["payload_bytes"] == len(payload) and last["payload_digest"] == hashlib.sha256(payload).hexdigest()
        if last["record_type"] == "response":
            assert b"".join(p["data"] for p in parts) == payload
            at = 0
            for p in parts:  # incremental digests
                at += len(p["data"])
                assert p["bytes_so_far"] == at and p["digest_so_far"] == hashlib.sha256(payload[:at]).hexdigest() and len(p["data"]) <= 1000
    kinds = {i: (p[-1]["record_type"], p[-1]["refers_to"]) for i, p in got.items()}
    assert kinds == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert len(got[6]) == 13


def test_archives_are_plain_warc(spark, tmp_path):
    folder = written(spark, [(1, "http://a/", b"<html>")]).removeprefix("file:")
    import glob

    data = gzip.open(glob.glob(f"{folder}/*.warc.gz")[0]).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"<html>\r\n\r\n\r\n".replace(b"\r\n\r\n\r\n", b"\r\n\r\n"))


def test_repeated_smallest_id_and_empty_table(spark):
    chunks = warc.read_chunks(spark, written(spark, [(1, "u", BIG), (1, "u", BIG), (2, "u", BIG)])).where("is_last")
    assert sorted(r["record_type"] for r in chunks.collect()) == ["response", "response", "revisit"]
    assert warc.read_chunks(spark, written(spark, [])).count() == 0


def test_query_against_plain_hashes(spark, tmp_path):
    pages = [(i, f"u{i}", h, "extra") for i, h in enumerate(["é" * 60, "é" * 60, None, "", "q" * 99, "q" * 99])]
    spark.createDataFrame(pages, "page_id long, url string, html string, payload string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.op1_warc_chunked(spark, str(tmp_path)).collect()}
    for i, _, h, _ in pages:
        data = (h or "").encode()
        assert got[i] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if i == 1 else "response", 0 if i == 1 else None)
    assert F is not None


def record(kind, body, *fields):
    return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{kind}>", *fields, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    html = b"<html>" + b"y" * 3000
    sha256 = hashlib.sha256(html).hexdigest()
    whole = [
        record("warcinfo", b"software: other\r\n", "Content-Type: application/warc-fields"),
        record("request", b"GET / HTTP/1.0\r\nHost: a\r\n\r\n", "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=request"),
        record("response", http + html, "WARC-Target-URI: http://a/", "Content-Type: application/http;msgtype=response", "WARC-Payload-Digest: sha1:ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        record("revisit", http, "WARC-Target-URI: http://a/", "Content-Type: application/http", f"WARC-Payload-Digest: sha256:{base64.b32encode(hashlib.sha256(html).digest()).decode()}"),
        record("metadata", b"", "Content-Type: application/warc-fields"),
        record("resource", html, "Content-Type: text/html"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(whole))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in whole))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(whole)))  # one member for all
    rows = warc.read_chunks(spark, f"file://{tmp_path}", chunk_bytes=1000).collect()
    for name in ("a.warc", "b.warc.gz", "c.warc.gz"):
        mine = sorted((r for r in rows if r["archive"].endswith(name)), key=lambda r: (r["record_offset"], r["chunk_no"]))
        last = [r for r in mine if r["is_last"]]
        assert [r["record_type"] for r in last] == ["warcinfo", "request", "response", "revisit", "metadata", "resource"]
        assert [r["payload_bytes"] for r in last] == [17, 0, len(html), None, 0, len(html)]
        assert last[2]["payload_digest"] == last[3]["payload_digest"] == last[5]["payload_digest"] == sha256
        assert b"".join(r["data"] for r in mine if r["record_type"] == "response") == html


def test_a_payload_of_many_chunks(spark):
    payload = bytes(range(256)) * 20_000
    chunks = warc.read_chunks(spark, written(spark, [(1, "u", payload), (2, "u", payload)])).orderBy("row_id", "chunk_no").collect()
    first = [r for r in chunks if r["row_id"] == 1]
    assert len(first) == 5 and b"".join(r["data"] for r in first) == payload and max(len(r["data"]) for r in first) == 1 << 20
    assert first[-1]["digest_so_far"] == hashlib.sha256(payload).hexdigest() and [r["record_type"] for r in chunks if r["row_id"] == 2] == ["revisit"]


def test_more_digests_than_are_broadcast(spark):
    rows = spark.createDataFrame([(i, "u", bytes([i % 5]) * 200) for i in range(30)], SCHEMA)
    plain = lambda limit: sorted((r["row_id"], r["refers_to"]) for r in warc.resolve_revisits(rows, broadcast_digests=limit).collect())
    assert plain(0) == plain(100) == [(i, None if i < 5 else i % 5) for i in range(30)]


def test_a_line_without_end(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0 " + b"x" * (3 << 20))
    with pytest.raises(Exception, match="a line of more than"):
        warc.read_chunks(spark, f"file://{tmp_path}").collect()
