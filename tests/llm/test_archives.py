from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zipfile
from collections import Counter

import pytest

from paylens.llm import wacz
from paylens.llm.workspace import Workspace

SCHEMA = "page_id bigint, url string, html string, sha string, first bigint, is_first string, archive string"
ROWS = [
    (3, "http://a/é?x=1", "<p>same é</p>"), (1, "http://b", "<p>same é</p>"), (2, None, None), (7, "u\r\nX: y", ""), (9, "u", "\r\n\r\nWARC/1.1\r\n"),
    (5, "http://c", "x" * 300_000), (1, "http://again", "<p>same é</p>"), (None, "n", "<p>same é</p>"), (None, None, "only null"), (8, "z", "q\x00\x1f"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 0, "x", "x") for r in rows], SCHEMA).repartition(3)


def expected(rows, min_bytes=0):
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", []).append(i)
    out = Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        ids = [x for x in first[html or ""] if x is not None]
        least = min(ids) if ids else None
        response = len(body) < min_bytes or i == least
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out[i, len(body), digest, "response" if response else "revisit", None if response else least] += 1
    return out


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_round_trip(spark, min_bytes):
    got = wacz.archive_round_trip(pages(spark), min_bytes).collect()
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[f] for f in fields) for r in got) == expected(ROWS, min_bytes)
    html = {(r["page_id"], r["html"]) for r in got if r["record_type"] == "response"}
    assert (5, "x" * 300_000) in html and (9, "\r\n\r\nWARC/1.1\r\n") in html and (8, "q\x00\x1f") in html


def test_many_copies_of_one_page(spark):
    """A third of all pages equal: one response, all others refer to it, their payloads do not move."""
    rows = [(i, f"u{i}", "<p>hot</p>" * 50 if i % 3 == 0 else f"<p>{i}</p>") for i in range(100, 9100)]
    got = wacz.archive_round_trip(pages(spark, rows)).groupBy("record_type", "refers_to").count().collect()
    assert {(r["record_type"], r["refers_to"]): r["count"] for r in got} == {("response", None): 6001, ("revisit", 102): 2999}


def test_no_pages(spark):
    assert wacz.archive_round_trip(pages(spark).filter("page_id = 77")).count() == 0


def test_archives_are_zip_files_with_stored_members(spark, monkeypatch):
    folder = Workspace(spark, "t").folder("a")
    wacz.write_archives(pages(spark), folder)
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content").collect()
    records = []
    for f in files:
        with zipfile.ZipFile(io.BytesIO(bytes(f["content"]))) as z:
            assert z.testzip() is None and z.comment == b"\n"
            assert {i.filename: i.compress_type for i in z.infolist()} == {wacz.DATA_MEMBER: 0, wacz.INDEX_MEMBER: 0}
            records += gzip.decompress(z.read(wacz.DATA_MEMBER)).split(b"WARC/1.1\r\nWARC-Type: ")[1:]
    assert len(records) == len(ROWS)


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_forms(tmp_path, zip64):
    members = [("archive/data.warc.gz", b"abc" * 50), ("x", b""), ("indexes/é", b"i")]
    path = tmp_path / "a.zip"
    path.write_bytes(wacz.zip_members(members, comment_length=1, zip64=zip64) + b"\n")
    with zipfile.ZipFile(path) as z:
        assert [(n, z.read(n)) for n in z.namelist()] == members
    source = wacz.ByteRanges(f"file://{path}")
    found = wacz.zip_directory(source)
    for name, body in members:
        at, size = wacz.member_data(source, found[name])
        assert source.read(at, size) == body


def test_python_zip64_and_packed_members(tmp_path):
    path = tmp_path / "b.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as m:
            m.write(b"hello")
        z.writestr("packed", b"a" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside, and more than twenty-two bytes"
    source = wacz.ByteRanges(str(path))
    found = wacz.zip_directory(source)
    assert source.read(*wacz.member_data(source, found["big"])) == b"hello"
    with pytest.raises(ValueError):
        wacz.member_data(source, found["packed"])
    with pytest.raises(ValueError):
        source.read(0, 10_000_000)
