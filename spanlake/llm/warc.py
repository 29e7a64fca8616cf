"""WARC writing and sequential reading.

Writer: one gzip member per record, archives of bounded size, written by the tasks into a
shared folder; every attempt writes names of its own and only the names that a finished
task reports enter the manifest, so lost executors leave no half archive behind.
Records of equal payloads (at least ``min_bytes`` long) after the one with the smallest
page id are ``revisit`` records: headers and a reference, no payload.

Reader: each archive is read in chunks, decompressed incrementally member by member, each
record is framed by its content length, and block and payload digests are verified; a
damaged or truncated archive raises ``WarcError``.

Defined results: a null html is the empty payload, a null url leaves the target out; rows
that repeat a page id and payload have the same record type; among equal payloads a row
without page id is a revisit if any row has one, else a response; control characters in
urls are percent-encoded; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import materialize, python_ready, table
from spanlake.session import scratch_dir

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
               "record_type string, refers_to long")


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page_urn(page_id)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a byte stream, one at a time."""
    z, out, rest = None, [], b""
    while True:
        data = rest or stream.read(CHUNK)
        rest = b""
        if not data:
            if z is not None:
                raise WarcError("truncated gzip member")
            return
        if z is None:
            z, out = zlib.decompressobj(31), []
        try:
            out.append(z.decompress(data))
        except zlib.error as e:
            raise WarcError(f"damaged gzip member: {e}") from None
        if z.eof:
            rest = z.unused_data
            z = None
            yield b"".join(out)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for x in lines:
        key, colon, value = x.decode("utf-8").partition(":")
        if not colon:
            raise WarcError(f"not a header line: {x[:80]!r}")
        out[key.strip().lower()] = value.strip()
    return out


def parse(data: bytes) -> tuple:
    """One member's record as a row of READ_SCHEMA; verifies framing and digests."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    try:
        h = _headers(lines[1:])
        size = int(h["content-length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise WarcError("content length does not frame the record")
        if h["warc-block-digest"] != f"sha1:{digest(block)}":
            raise WarcError("block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(_headers(http.split(b"\r\n")[1:])["content-length"])
        kind, named = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != n or digest(payload) != named):
            raise WarcError("payload digest differs")
        refers = _page_of(h["warc-refers-to"]) if kind == "revisit" else None
        return (_page_of(h["warc-record-id"]), h.get("warc-target-uri"), payload if kind == "response" else None, n,
                named, kind, refers)
    except KeyError as e:
        raise WarcError(f"missing header {e}") from None
    except ValueError as e:  # a length that is no number, a header that is no UTF-8
        raise e if isinstance(e, WarcError) else WarcError(f"unreadable header: {e}") from None


def _digests(batches):
    for b in batches:
        payloads = [(x.as_py() or "").encode() for x in b.column(1)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([digest(x) for x in payloads]), pa.array([len(x) for x in payloads], pa.int64())],
            names=["page_id", "payload_digest", "payload_bytes"])


def _with_digest(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([digest((x.as_py() or "").encode()) for x in b.column(2)], pa.string())],
            names=["page_id", "url", "html", "payload_digest"])


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with their payload digest and ``first_id``, the response of their payload
    (null where the page's payload is met once or is too short)."""
    python_ready(pages)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    firsts = (base.select("page_id", "html")
              .mapInArrow(_digests, "page_id long, payload_digest string, payload_bytes long")
              .where(F.col("payload_bytes") >= min_bytes)
              .groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
              .where("n > 1").select("payload_digest", "first_id"))
    return (base.mapInArrow(_with_digest, "page_id long, url string, html string, payload_digest string")
            .join(firsts, "payload_digest", "left")
            .select("page_id", "url", "html", "payload_digest", "first_id"))


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a record below ``root``; returns the manifest (path, records,
    bytes), itself written once."""

    def run(batches):
        filesystem, base = _open(root)
        filesystem.create_dir(base, recursive=True)
        done, out, path, n, size = [], None, "", 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, n, size))
                out = None

        for b in batches:
            for page_id, url, html, named, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = filesystem.open_output_stream(path)
                revisit = first is not None and first != page_id
                data = member(record(page_id, url, (html or "").encode(), named, first, revisit))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)],
                                             names=["path", "records", "bytes"])

    found = revisits(pages, min_bytes).mapInArrow(run, "path string, records long, bytes long")
    return materialize(found, "warc-manifest")


def read_archives(manifest: DataFrame, root: str, payload: bool = True) -> DataFrame:
    """The records of the archives a manifest names (READ_SCHEMA); ``payload=False`` leaves
    the payload column null after verification."""
    python_ready(manifest)

    def run(batches):
        filesystem, _ = _open(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64())])

        def emit(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with filesystem.open_input_stream(path) as stream:
                    for data in members(stream):
                        row = parse(data)
                        rows.append(row if payload else (*row[:2], None, *row[3:]))
                        held += len(data) if payload else 200
                        if held >= 8 << 20:
                            yield emit(rows)
                            rows, held = [], 0
                if rows:
                    yield emit(rows)

    archives = manifest.select("path")
    return archives.repartition(max(1, archives.count()), "path").mapInArrow(run, READ_SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), root)
    return read_archives(manifest, root, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31), 1)), '')
         AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN CAST(first_id AS DOUBLE) END AS refers_to
FROM p"""
