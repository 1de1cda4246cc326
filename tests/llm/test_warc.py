"""WARC archives: exact round trips, odd payloads, foreign archives."""

import base64
import gzip
import hashlib
import time

import pyarrow as pa
import pytest

from oreline.llm import warc
from oreline.llm.queries import op5_warc


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def test_query_equals_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    expected = []
    for p in pages:
        html = p.html or ""
        earlier = None if first[html] == p.page_id else first[html]
        kind = "response" if earlier is None else "revisit"
        expected.append((p.page_id, len(html.encode()), sha(html), kind, earlier))
    assert sorted(map(tuple, op5_warc(spark, sf_dir).collect()), key=repr) == sorted(expected, key=repr)


ODD = [
    (5, "http://a/", "same"),
    (3, "http://b/ x\r\ny", "same"),
    (9, None, "same"),
    (1, "http://c/", None),
    (2, "http://d/", ""),
    (7, "http://e/WARC/1.1\r\n", "before WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n after"),
    (8, "", "\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\n"),
    (None, "http://f/", "same"),
    (None, "http://g/", "alone"),
    (None, "http://h/", "alone"),
    (11, "http://i/", "ümläut \U0001f600\x00"),
    (11, "http://i/", "ümläut \U0001f600\x00"),
    (12, "http://j/", "long " * 300_000),
]


def test_odd_pages(spark):
    frame = spark.createDataFrame([(*r, "x") for r in ODD], "page_id long, url string, html string, digest string")
    rows = warc.round_trip(frame).collect()
    assert len(rows) == len(ODD)
    got = sorted(
        ((r.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.record_type, r.refers_to) for r in rows),
        key=repr,
    )
    expected = []
    for page, _, html in ODD:
        html = html or ""
        refers = {"same": 3, "": 1}.get(html)
        refers = None if refers in (None, page) else str(refers)
        kind = "revisit" if refers else "response"
        expected.append((None if page is None else str(page), len(html.encode()), sha(html), kind, refers))
    assert got == sorted(expected, key=repr)
    assert all(r.request and r.metadata for r in rows)
    assert all(r.response.intact for r in rows if r.response.record_type == "response")
    assert warc.round_trip(frame.filter("page_id = 99")).count() == 0


def test_payloads_come_back_and_small_ones_are_never_revisits(spark, tmp_path):
    frame = spark.createDataFrame(ODD, "page_id long, url string, payload string").repartition(3)
    folder = str(tmp_path / "archives")
    warc.write(frame, folder, least=5)
    rows = warc.captures(warc.read_records(spark, folder)).collect()
    found = sorted((r.response.record_type, bytes(r.response.payload or b"")) for r in rows)
    assert found == sorted(("response", (h or "").encode()) for *_, h in ODD)


def record(kind, ident, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "Content-Length": str(len(block)), **more}
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    parts = [
        record("warcinfo", "<i>", b"software: x\r\n"),
        record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", "<r>", http, WARC_Concurrent_To="<q>", WARC_Payload_Digest="sha1:WRONG"),
        record("metadata", "<m>", b"via: y\r\n", WARC_Concurrent_To="<q>"),
        record("response", "<s>", http),
    ]
    with open(tmp_path / "one.warc.gz", "wb") as out:  # a gzip member for each record
        for part in parts:
            out.write(gzip.compress(part))
    rows = warc.captures(warc.read_records(spark, str(tmp_path))).collect()
    assert len(rows) == 2
    whole = next(r for r in rows if r.request)
    assert whole.metadata.fields == {"via": "y"} and whole.response.payload == b"body"
    assert whole.response.intact is False and whole.page_id is None
    with open(tmp_path / "two.warc.gz", "wb") as out:
        out.write(gzip.compress(parts[2][:-15]))
    with pytest.raises(Exception, match="cut off"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_pages_full_of_version_lines_are_read_in_linear_time():
    kind = pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in ("record_id", "payload")])
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"WARC/1.1\r\n" * 200_000
    data = record("response", "<r>", block) + record("response", "<s>", b"HTTP/1.1 200 OK\r\n\r\nshort")
    pieces = data.split(b"WARC/1.1\r\n")
    batch = pa.record_batch([pa.array(["f"] * len(pieces)), pa.array(pieces)], names=["file_path", "piece"])
    begun = time.process_time()
    rows = [r for b in warc._records(kind)(iter([batch])) for r in b.to_pylist()]
    assert time.process_time() - begun < 20
    assert [r["record_id"] for r in rows] == ["<r>", "<s>"]
    assert rows[0]["payload"] == b"WARC/1.1\r\n" * 200_000 and rows[1]["payload"] == b"short"
