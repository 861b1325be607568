"""WARC archives: one gzip member per record, revisit records for repeated payloads, and a sequential reader that verifies."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.session import scratch_path

# Bytes of compressed records after which a file is closed; bytes read at a time.
ROLL, CHUNK = 128 << 20, 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Record ids are this prefix and the page's number, so either follows from the other.
_PAGES = 0x5041474553AA4000 << 64
_NO_PAGE = 0x4E4F5041474540AA


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    number = _PAGES | (page_id & 0xFFFFFFFFFFFFFFFF) if page_id is not None else _NO_PAGE << 64
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(identifier: str) -> int | None:
    number = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    if number >> 64 != _PAGES >> 64:
        return None
    low = number & 0xFFFFFFFFFFFFFFFF
    return low - (1 << 64) if low >> 63 else low


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, compressed as a gzip member. A revisit keeps the HTTP header only, with the length of the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header(url) if url else 'urn:page:' + str(page_id)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder named as Spark names it."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; (path, records, bytes) of each file.

    Payload is the html in UTF-8, a null one is empty. Of pages with equal payloads of at least ``least_bytes`` bytes the one with
    the smallest page_id is a response, others are revisits of it; shorter ones are all responses, and so are rows that
    repeat page_id and payload. A page without page_id is a revisit if another page has its payload. Files have names of their own
    for each attempt of a task, and the returned table, to be written before use, names those of the attempts that counted:
    a lost executor leaves files that nobody reads.
    """
    digested = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digested = digested.withColumn("sha", F.unhex(F.sha1("html")))
    first = digested.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
    rows = digested.join(first.where("pages > 1 and first is not null").select("sha", "first"), "sha", "left").select("page_id", "url", "html", "first")

    def run(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        made, out, name = [], None, None
        size = count = 0
        for batch in batches:
            for page_id, url, html, first_id in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                data = record(page_id, url, html.encode("utf-8"), first_id, first_id is not None and first_id != page_id, date)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root.rstrip('/')}/{name}")
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ROLL:
                    out.close()
                    made.append((f"{folder.rstrip('/')}/{name}", count, size))
                    out, size, count = None, 0, 0
        if out is not None:
            out.close()
            made.append((f"{folder.rstrip('/')}/{name}", count, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["path", "records", "bytes"])

    return rows.mapInArrow(run, "path string, records long, bytes long")


@dataclass
class _Record:
    offset: int
    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload: bytes | None = None
    problem: str | None = None


class _Framer:
    """Reads one record from decompressed pieces: headers, then Content-Length bytes of block, digests on the way."""

    def __init__(self, offset: int, keep: bool):
        self.out, self.keep = _Record(offset), keep
        self.head, self.left, self.tail = b"", None, b""
        self.http_head: bytes | None = b""
        self.block, self.payload, self.kept = hashlib.sha1(), hashlib.sha1(), []

    def feed(self, data: bytes) -> None:
        if self.left is None:
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                return
            lines = self.head[:at].decode("utf-8", "replace").split("\r\n")
            self.out.headers = _fields(lines[1:])
            length = self.out.headers.get("content-length", "")
            if not lines[0].startswith("WARC/") or not length.isdigit():
                self.out.problem = "header"
            self.left = int(length) if length.isdigit() else 0
            data = self.head[at + 4 :]
            self.head = b""
        part, rest = data[: self.left], data[self.left :]
        self.left -= len(part)
        self.block.update(part)
        if self.http_head is not None:
            self.http_head += part
            at = self.http_head.find(b"\r\n\r\n")
            if at >= 0:
                self.out.http = _fields(self.http_head[:at].decode("latin-1").split("\r\n")[1:])
                part, self.http_head = self.http_head[at + 4 :], None
            else:
                part = b""
        self.payload.update(part)
        self.out.payload_bytes += len(part)
        if self.keep:
            self.kept.append(part)
        self.tail = (self.tail + rest)[:8]

    def done(self, complete: bool) -> _Record:
        out, headers = self.out, self.out.headers
        told = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        if out.problem is None:
            if not complete or self.left != 0:
                out.problem = "truncated"
            elif self.tail != b"\r\n\r\n":
                out.problem = "length"
            elif headers.get("warc-block-digest", told(self.block)) != told(self.block):
                out.problem = "block digest"
            elif headers.get("warc-type") == "response" and headers.get("warc-payload-digest", told(self.payload)) != told(self.payload):
                out.problem = "payload digest"
        if headers.get("warc-type") == "revisit":
            length = out.http.get("content-length", "0")
            out.payload_bytes = int(length) if length.isdigit() else 0
        out.payload = b"".join(self.kept) if self.keep else None
        return out


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in lines) if s}


def records(stream, keep: bool = False) -> Iterator[_Record]:
    """Records of a file object in order, decompressed piece by piece; a broken member ends the file with a row that names the problem."""
    offset, data = 0, stream.read(CHUNK)
    while data:
        member, framer, used = zlib.decompressobj(31), _Framer(offset, keep), 0
        try:
            while data and not member.eof:
                piece = member.decompress(data, CHUNK)
                framer.feed(piece)
                rest = member.unused_data if member.eof else member.unconsumed_tail
                used += len(data) - len(rest)
                data = rest or (b"" if member.eof else stream.read(CHUNK))
        except zlib.error:
            framer.out.problem = framer.out.problem or "compression"
        yield framer.done(member.eof)
        if not member.eof:
            return
        offset += used
        data = data or stream.read(CHUNK)


def read_archives(files: DataFrame, keep: bool = False) -> DataFrame:
    """Records of the archives named by ``path``, one row each, read in order within a file.

    path, offset (of the member), record_type, page_id, target_uri, payload_bytes, payload_digest, refers_to (page of the response),
    problem (null if lengths and digests hold), payload (null unless ``keep``). A file is one task's work; memory is one record's
    payload with ``keep``, else a few chunks.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, where = _store(path)
                rows = []
                with store.open_input_stream(where) as stream:
                    for r in records(stream, keep):
                        rows.append((
                            path, r.offset, r.headers.get("warc-type"), _page(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), r.payload_bytes,
                            (r.headers.get("warc-payload-digest") or "").removeprefix("sha1:"), _page(r.headers.get("warc-refers-to")), r.problem, r.payload))
                        if len(rows) >= 2000 or keep:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    paths = files.select("path")
    return paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism * 2)).mapInArrow(
        run, "path string, offset long, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, problem string, payload binary")


def _page(identifier: str | None) -> int | None:
    try:
        return page_of(identifier) if identifier else None
    except ValueError:
        return None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ("path", "offset", "record_type", "page_id", "target_uri", "payload_bytes", "payload_digest", "refers_to", "problem", "payload")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def archived(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` below the shared folder and read the archives back."""
    manifest = scratch_path(spark, "warc-files")
    write_archives(pages, scratch_path(spark, "warc"), least_bytes=least_bytes).write.parquet(manifest)
    return read_archives(spark.read.parquet(manifest))
