"""WARC archives: gzip members written by Spark, read again by tasks that scan byte ranges for members.

Files are written by Spark's own text sink, so that its commit protocol covers lost executors, on any file system: a
row is a gzip member without its last byte, which is zero and comes from the sink as the row's end. They are read by
byte range in Python through pyarrow's file systems; the archives' folder must be reachable by those.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.llm._shared import col, map_arrow, new_path

MAGIC = b"\x1f\x8b\x08"
RANGE = 8 << 20  # bytes of a file whose records one row of the reader's plan owns
PROBE = 512  # bytes of a candidate that are inflated to see its header
READ = 1 << 20
DATE = "2000-01-01T00:00:00Z"  # archives of the same pages are the same bytes
RESPONSE, REVISIT = "response", "revisit"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to=None, digest: str | None = None) -> bytes:
    """One record with its HTTP head; a revisit has the head alone, whose Content-Length still counts the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == RESPONSE else b"")
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or f"urn:page:{page_id}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest or digest_of(payload)}"]
    if kind == REVISIT:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member, and an empty one after it if the last byte, of the length, wouldn't be zero."""
    z = zlib.compressobj(level, wbits=31)
    out = z.compress(data) + z.flush()
    if out[-1]:
        z = zlib.compressobj(level, wbits=31)
        out += z.flush()
    return out


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse(data: bytes) -> Record:
    head, block = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    headers = fields(lines)
    block = block[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, fields(http.decode("utf-8", "replace").split("\r\n")[1:]), payload)


def write(records: DataFrame, path: str) -> None:
    """records: one binary column, a gzip member whose last byte is zero. Writes .gz files of members into path."""
    ends = F.col("member").substr(F.lit(1), F.length("member") - 1).cast("string")
    records.select(ends.alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the archives; no content is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")


def _open(path: str):
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    if (u := urlparse(path)).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(u.path))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def scan(path: str, start: int, end: int, range_bytes: int = READ):
    """Yields (offset, record bytes) of the members that start in [start, end) of a file, and reads on to the end of
    the last of them. A candidate is gzip magic whose first bytes inflate to a WARC header; a member is passed over
    to its end, so nothing inside it is a candidate, and what looks like one before the first member is refused."""
    with _open(path) as f:
        size, at, buf, base = f.size(), start, b"", start

        def more() -> bool:
            nonlocal buf
            f.seek(base + len(buf))
            got = f.read(range_bytes)
            buf += got
            return bool(got)

        while at < min(end, size):
            if at - base > range_bytes:
                buf, base = buf[at - base :], at
            while (hit := buf.find(MAGIC, at - base)) < 0 and base + len(buf) < end + len(MAGIC) - 1:
                at = max(at, base + len(buf) - len(MAGIC) + 1)
                buf, base = buf[at - base :], at
                if not more():
                    return
            if hit < 0 or base + hit >= end:
                return
            at = base + hit
            while len(buf) < hit + PROBE and more():
                pass
            data, used = _member(buf, hit, more, lambda: buf) if _is_record(buf[hit : hit + PROBE]) else (None, 1)
            if data:
                yield at, data
            at += used


def _is_record(raw: bytes) -> bool:
    z = zlib.decompressobj(wbits=31)
    try:
        got = z.decompress(raw, 16)
    except zlib.error:
        return False
    return got.startswith(b"WARC/1.") or (z.eof and not got)


def _member(buf: bytes, hit: int, more, now) -> tuple[bytes | None, int]:
    """The content of the member at hit and its length; (None, 1) if it is broken. more() makes now() longer."""
    z, parts, at = zlib.decompressobj(wbits=31), [], hit
    try:
        while not z.eof:
            if at == len(buf):
                if not more():
                    return None, 1
                buf = now()
            parts.append(z.decompress(buf[at : at + 65536]))
            at = min(len(buf), at + 65536)
        return b"".join(parts), at - len(z.unused_data) - hit
    except zlib.error:
        return None, 1


def read(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, offset, record binary) of every record below path. A row of the plan is a byte range; ranges are dealt
    evenly, and a record belongs to the range it starts in, however the file was cut."""
    cut = files(spark, path).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = cut.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end")).repartition(max(1, min(10_000, cut.count())))

    def run(batches):
        for b in batches:
            for p, s, e in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows, size = [], 0
                for at, data in scan(p, s, e):
                    rows.append((at, data))
                    size += len(data)
                    if size > 4 << 20:
                        yield out(p, rows)
                        rows, size = [], 0
                if rows:
                    yield out(p, rows)

    def out(p, rows):
        at, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([p] * len(rows)), pa.array(at, pa.int64()), pa.array(data, pa.binary())], names=["file", "offset", "record"])

    return ranges.mapInArrow(run, "file string, offset long, record binary")


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Writes a record for every row of pages. Of the rows whose payloads (html as UTF-8; null: empty) are equal and
    have `least` bytes or more, that with the largest id is the response and the others revisit it; smaller payloads
    are all responses. Rows with the same largest id differ in url or not at all: that with the largest url hash is the
    response, and rows that are wholly equal to it are responses too. Null ids order below all others.

    Payloads are compared by SHA-256. Only (digest, id) pairs that occur twice are joined back, so a payload in a
    third of all rows is a hot key of one join at most, which adaptive skew joins split.
    """
    html = F.coalesce(col(html_col), F.lit("")).cast("binary")
    t = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("same"))
    best = t.where(F.length("html") >= least).groupBy("same").agg(F.max(F.struct("id", F.xxhash64("url").alias("u"))).alias("best"), F.count("*").alias("n")).where("n > 1").select(F.col("same").alias("twice"), "best")
    t = t.join(best, F.col("same") == F.col("twice"), "left")
    top = (F.col("id").eqNullSafe(F.col("best.id"))) & (F.xxhash64("url") == F.col("best.u"))
    t = t.select("id", "url", "html", F.when(F.col("best").isNotNull() & ~top, F.lit(True)).otherwise(False).alias("again"), F.col("best.id").alias("first"))

    def run(batches):
        for b in batches:
            made = []
            for i, url, html, again, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made.append(member(record("" if i is None else i, url, html, REVISIT if again else RESPONSE, "" if first is None else first)))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    write(map_arrow(t, run, "member binary"), path)


PARSED = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def parsed(records: DataFrame, payloads: bool = True) -> DataFrame:
    """PARSED of the records: a response's digest is computed from its payload as read and held against its header."""

    def number(uri: str | None):
        text = (uri or "").strip("<>").rpartition(":")[2]
        return int(text) if text else None

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(0).to_pylist():
                r = parse(data)
                kind, said = r.headers["warc-type"], r.headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == RESPONSE and digest_of(r.payload) != said:
                    raise ValueError(f"{r.headers['warc-record-id']} doesn't match its digest")
                rows.append((number(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), int(r.http["content-length"]), said, kind, number(r.headers.get("warc-refers-to")), *([r.payload if kind == RESPONSE else None] if payloads else [])))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    spec = PARSED if payloads else PARSED.removesuffix(", payload binary")
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in spec.split(", ")]
    names = [x.split()[0] for x in spec.split(", ")]
    return map_arrow(records.select("record"), run, spec)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """op8: writes all pages as archives, reads them back by byte ranges, and returns what their records say."""
    path = new_path(spark, "warc")
    archive(pages, path)
    return parsed(read(spark, path), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h), d AS (
  SELECT page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha1(p.h) AS hex, top FROM p JOIN m ON p.h = m.h
), b AS (
  SELECT *, list_transform(range(0, 8), lambda g: list_sum(list_transform(range(0, 5), lambda k:
      (CAST(instr('0123456789abcdef', substr(hex, CAST(g * 5 + k + 1 AS BIGINT), 1)) AS BIGINT) - 1) << CAST(16 - 4 * k AS BIGINT)))) AS parts FROM d
)
SELECT page_id, payload_bytes, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(v AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""
