"""Web archives packaged as ZIP files (the WACZ layout), written and read on Spark.

Writing: every page becomes a WARC record, gzipped by itself. Some megabytes of
records are one archive: a ZIP file with the stored members
``archive/data.warc.gz`` and ``indexes/index.cdx.gz`` (one JSON line per record
with its offset and length). An archive is one row of bytes and Spark's own text
writer puts each row in a file, so any file system that Spark writes to will do,
task retries leave no half archives, and the line end that the writer adds is the
ZIP file's one-byte comment.

Reading: the directory at the end of each file is parsed (with its ZIP64 forms),
the stored members are located, the index is read, and each record is read by its
range. Nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.workspace import Workspace, partitions, ship_package

ARCHIVE_BYTES, ARCHIVE_RECORDS = 8 << 20, 50_000
SALTS = 16
DATE = "2024-01-01T00:00:00Z"

# ---- fixed values: names and signatures of the formats ----
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx.gz"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOCAL_SIG, CENTRAL_SIG, END_SIG = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64_SIG, LOCATOR_SIG = b"PK\x06\x06", b"PK\x06\x07"


# ---------------------------------------------------------------- ZIP


def zip_members(members: list[tuple[str, bytes]], comment_length: int = 0, zip64: bool = False) -> bytes:
    """A ZIP file of stored members, with room for a comment of the given length that
    the caller appends. ``zip64`` writes the 64-bit forms throughout; they are also
    used where a size or an offset needs them."""
    out, central = bytearray(), bytearray()
    for name, body in members:
        raw, crc, at = name.encode("utf-8"), zlib.crc32(body), len(out)
        wide = zip64 or len(body) >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        size = 0xFFFFFFFF if wide else len(body)
        extra = struct.pack("<HHQQ", 1, 16, len(body), len(body)) if wide else b""
        version = 45 if wide else 20
        out += LOCAL_SIG + struct.pack("<HHHHHIIIHH", version, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra
        out += body
        extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), at) if wide else b""
        central += CENTRAL_SIG + struct.pack(
            "<HHHHHHIIIHHHHHII", version, version, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0,
            0xFFFFFFFF if wide else at,
        ) + raw + extra
    at, n = len(out), len(members)
    out += central
    wide = zip64 or at >= 0xFFFFFFFF or n >= 0xFFFF
    if wide:
        end64 = len(out)
        out += END64_SIG + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), at)
        out += LOCATOR_SIG + struct.pack("<IQI", 0, end64, 1)
    out += END_SIG + struct.pack(
        "<HHHHIIH", 0, 0, 0xFFFF if wide else n, 0xFFFF if wide else n, 0xFFFFFFFF if wide else len(central),
        0xFFFFFFFF if wide else at, comment_length,
    )
    return bytes(out)


class ByteRanges:
    """Reads of byte ranges of a file on any file system that pyarrow opens, or a local one."""

    def __init__(self, path: str):
        parts = urlsplit(path)
        if parts.scheme in ("", "file"):
            self.file = open(unquote(parts.path) if parts.scheme else path, "rb")  # noqa: SIM115
            self.size = self.file.seek(0, 2)
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            self.file = system.open_input_file(inner)
            self.size = self.file.size()

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(size)
        if len(out) != size:
            raise ValueError(f"file ends inside the range {at} + {size}")
        return out

    def close(self) -> None:
        self.file.close()


def zip_directory(source: ByteRanges) -> dict[str, tuple[int, int, int]]:
    """Member name -> (offset of its local header, size of its data, method)."""
    tail_at = max(0, source.size - 65_557)
    tail = source.read(tail_at, source.size - tail_at)
    end = tail.rfind(END_SIG)
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(END_SIG, 0, end)
    if end < 0:
        raise ValueError("no ZIP directory")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    locator = source.read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if locator[:4] == LOCATOR_SIG:
        head = source.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if head[:4] != END64_SIG:
            raise ValueError("broken ZIP64 directory")
        count, size, at = struct.unpack_from("<QQQ", head, 32)
    central, out, p = source.read(at, size), {}, 0
    for _ in range(count):
        if central[p : p + 4] != CENTRAL_SIG:
            raise ValueError("broken ZIP directory")
        method, = struct.unpack_from("<H", central, p + 10)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", central, p + 20)
        offset, = struct.unpack_from("<I", central, p + 42)
        name = central[p + 46 : p + 46 + n].decode("utf-8")
        extra, q = central[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                # only the fields that did not fit are there, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            q += 4 + length
        out[name] = (offset, packed, method)
        p += 46 + n + m + k
    return out


def member_data(source: ByteRanges, entry: tuple[int, int, int]) -> tuple[int, int]:
    """(offset, size) of a stored member's data."""
    at, size, method = entry
    if method != 0:
        raise ValueError("the member is compressed as a whole; its records cannot be read by range")
    head = source.read(at, 30)
    if head[:4] != LOCAL_SIG:
        raise ValueError("broken local header")
    n, m = struct.unpack_from("<HH", head, 26)
    return at + 30 + n + m, size


# ---------------------------------------------------------------- WARC


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _field(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, first: int | None) -> bytes:
    """A response record, or without payload a revisit record (headers only) of the
    response ``first``; ``length`` and ``digest`` are those of the full payload."""
    is_first = payload is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if is_first else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if is_first else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if not is_first:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
        if first is not None:
            lines.append(f"X-Refers-To-Page-ID: {first}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block)."""
    end = raw.index(b"\r\n\r\n")
    first, *rest = raw[:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in rest)}
    size = int(headers["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return headers, block


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def gzipped(raw: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _archive(records: list[bytes], keys: list[dict]) -> bytes:
    at, lines = 0, []
    for record, key in zip(records, keys, strict=True):
        lines.append(json.dumps(key | {"offset": at, "length": len(record), "filename": DATA_MEMBER.rsplit("/", 1)[1]}))
        at += len(record)
    index = gzipped(("\n".join(lines) + "\n").encode("utf-8"))
    return zip_members([(DATA_MEMBER, b"".join(records)), (INDEX_MEMBER, index)], comment_length=1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, sha, length, first) -> archives; a row without html is a
    revisit of the page ``first``, of which length and digest are known."""

    def row(records: list[bytes], keys: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": pa.array([_archive(records, keys)], pa.binary())})

    records, keys, size = [], [], 0
    for batch in batches:
        for cells in zip(*batch.columns, strict=True):
            page_id, url, html, sha, length, first = (c.as_py() for c in cells)
            digest = base64.b32encode(bytes.fromhex(sha)).decode("ascii")
            payload = None if html is None else html.encode("utf-8")
            raw = gzipped(warc_record(page_id, url, payload, length, digest, first))
            records.append(raw)
            keys.append({"url": url, "type": "revisit" if payload is None else "response"})
            size += len(raw)
            if size >= ARCHIVE_BYTES or len(records) >= ARCHIVE_RECORDS:
                yield row(records, keys)
                records, keys, size = [], [], 0
    if records:
        yield row(records, keys)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into archives in ``folder``.

    Of rows with equal payloads of ``min_bytes`` or more the one with the smallest
    page_id is a response record and the others are revisits of it; rows that repeat
    that page_id are responses too, and null ids come last. Rows with smaller
    payloads are all responses. Null html is the empty payload; a null url is left
    out. An empty table writes no archive. A very long payload is a record of its own
    archive. Other columns are ignored.

    Which page is the response of a digest is found on narrow rows. A payload moves once,
    to a task that digest and page_id decide, where those of other pages are dropped; a
    revisit needs its payload's length and digest only, so the copies of one page, be they
    a third of all, are joined and packed without it, over ``SALTS`` tasks a digest.
    """
    spark = pages.sparkSession
    ship_package(spark)
    body = F.coalesce(pages["html"], F.lit(""))
    base = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), body.alias("html"),
        F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).cast("bigint").alias("length"),
    )
    firsts = (
        base.where(F.col("length") >= min_bytes)
        .groupBy(F.col("sha").alias("f_sha"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    columns = ("page_id", "url", "html", "sha", "length")
    none = F.lit(None).cast("bigint").alias("first")
    is_first = (F.col("sha") == F.col("f_sha")) & F.col("page_id").eqNullSafe(F.col("first"))
    responses = base.where(F.col("length") >= min_bytes).join(firsts, is_first, "left_semi").select(*columns, none)
    small = base.where(F.col("length") < min_bytes).select(*columns, none)
    salted = firsts.where("copies > 1").select("f_sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"))
    others = base.select("page_id", "url", "sha", "length", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    revisits = (
        others.where(F.col("length") >= min_bytes)
        .join(salted, (F.col("sha") == F.col("f_sha")) & (F.col("salt") == F.col("f_salt")))
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha", "length", "first")
    )
    archives = responses.union(revisits) if min_bytes <= 0 else responses.union(small).union(revisits)
    # no more tasks than full archives, so that a small table is not thousands of tiny files
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(spark.sparkContext.defaultParallelism, size // ARCHIVE_BYTES)
    if tasks < partitions(spark):
        archives = archives.coalesce(tasks)
    packed = archives.mapInArrow(_pack, "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for path in batch.column("path"):
            source = ByteRanges(path.as_py())
            members = zip_directory(source)
            rows, held = [], 0
            for name in sorted(members):
                if not name.startswith("indexes/"):
                    continue
                index = zlib.decompress(source.read(*member_data(source, members[name])), 31)
                for line in index.decode("utf-8").splitlines():
                    entry = json.loads(line[line.index("{") :])
                    start, size = member_data_cached(source, members, "archive/" + entry["filename"])
                    if entry["offset"] + entry["length"] > size:
                        raise ValueError("index points past its archive")
                    headers, block = parse_record(zlib.decompress(source.read(start + entry["offset"], entry["length"]), 31))
                    rows.append(_row(headers, block))
                    held += len(block)
                    if held > 4 << 20:
                        yield made(rows)
                        rows, held = [], 0
            source.close()
            if rows:
                yield made(rows)


def member_data_cached(source: ByteRanges, members: dict, name: str) -> tuple[int, int]:
    known = source.__dict__.setdefault("known", {})
    if name not in known:
        known[name] = member_data(source, members[name])
    return known[name]


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers["warc-type"]
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    number = lambda name: int(headers[name]) if name in headers else None
    text = payload.decode("utf-8") if kind == "response" else None
    return number("x-page-id"), headers.get("warc-target-uri"), kind, length, digest, number("x-refers-to-page-id"), text


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in ``folder``: page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, html (null for revisits). Digests of
    responses are checked; a file that is no ZIP or lies about a record is an error."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(folder).select("path", "length").filter("length > 0")
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, html string"
    return files.repartition(partitions(spark)).select("path").mapInArrow(_unpack, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    folder = Workspace(pages.sparkSession, "wacz").folder("archives")
    write_archives(pages, folder, min_bytes)
    return read_archives(pages.sparkSession, folder)
