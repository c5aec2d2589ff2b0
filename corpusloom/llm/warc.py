"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Writing: a page becomes an HTTP response in chunked transfer framing; a block longer
than SEGMENT bytes is cut into a first record and continuation records, the last of
which states the total length. Of pages with equal payloads of at least 1000 bytes,
the one with the largest id is a response and the others are revisit records. A row
is a record and Spark's text writer ends each with the blank lines that WARC asks
for, so the part files are archives (gzip), of RECORDS_A_FILE records at most.

Reading: files (gzip, whole or a member a record, or plain) are parsed as streams by their
content lengths; a file is a task's unit and is held compressed, so it should have at most some
hundred megabytes. Whole records are decoded where they are read; the segments of the others
are grouped by origin id, put in order, checked (numbers without a gap, total length, CRLF
framing) and decoded. Archives of other writers are read too: any WARC version, folded header
lines, response and resource records with or without a digest (SHA-1, in base32 or hex, is
checked; other digests and truncated records aren't), and revisits with the standard fields
only. Other kinds of records (warcinfo, request, metadata, conversion) give no row.

Defined cases: null html is an empty payload; null ids are responses and refer to
nothing; rows with the same id and payload are each a response where that id is the
largest; an empty table writes no record and reads as none; a file that breaks the format or
segments that aren't whole raise ArchiveError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_known, shared_dir

SEGMENT = 1 << 16
CHUNK = 1 << 13
RECORDS_A_FILE = 4000
LEAST = 1000
END = "\r\n\r\n"
_CHUNKED = re.compile(rb"(?im)^transfer-encoding:[ \t]*chunked")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 9562's namespace for URLs


class ArchiveError(ValueError):
    """A record that breaks the format, or a set of segments that isn't whole."""


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for k in range(0, len(payload), CHUNK) if (p := payload[k : k + CHUNK])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ArchiveError("chunk size without its line end")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ArchiveError("chunk of another length than stated")
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if _CHUNKED.search(head) else body


def sha1_of(field: str | None) -> bytes | None:
    """The SHA-1 that a digest field states, in base32 or hex; None for other algorithms or none."""
    name, _, value = (field or "").partition(":")
    if name.lower() != "sha1":
        return None
    try:
        return bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError as e:
        raise ArchiveError(f"digest {field!r}") from e


def header(fields: dict) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n"


def records(name: str, page_id, url, payload: bytes, refers=None, refers_url=None) -> Iterator[bytes]:
    """The page's records, each without the blank lines that end it. name: distinct for each page row."""
    one = lambda k: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{name}#{k}')}>"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    base = {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": uri, "WARC-Page-ID": page_id, "WARC-Payload-Digest": digest}
    if refers is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        other = (refers_url or "").replace("\r", "%0D").replace("\n", "%0A")
        yield header({"WARC-Type": "revisit", "WARC-Record-ID": one(1), **base, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Page-ID": refers, "WARC-Refers-To-Target-URI": other, "WARC-Refers-To-Date": base["WARC-Date"], "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[k : k + SEGMENT] for k in range(0, len(block), SEGMENT)]
    for k, part in enumerate(parts, 1):
        fields = {"WARC-Type": "response" if k == 1 else "continuation", "WARC-Record-ID": one(k)}
        if k == 1:
            fields |= base | {"Content-Type": "application/http; msgtype=response"}
        if len(parts) > 1:
            fields |= {"WARC-Segment-Number": k, "WARC-Segment-Origin-ID": one(1) if k > 1 else None, "WARC-Segment-Total-Length": len(block) if k == len(parts) else None}
        yield header(fields | {"Content-Length": len(part)}) + part


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields (names in lower case) and block of each record of a binary stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"no record starts with {line[:40]!r}")
        fields, name = {}, ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            if line[:1] in b" \t" and name:  # a folded line goes on with the field before
                fields[name] += " " + line.decode("utf-8", "replace").strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
        if not fields.get("content-length", "").isdigit():
            raise ArchiveError("a record without a content length")
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ArchiveError("a record ends before its content length")
        yield fields, block


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """Segments (number, total length or None, bytes) in any order to the whole block."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(p[2] for p in parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1][1] != len(block):
        raise ArchiveError("segments are missing, repeated or of another total length")
    return block


def decisions(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers, refers_url of the pages that revisit another: small columns alone are shuffled."""
    heads = pages.select("page_id", "url", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length("html").alias("n"))
    heads = heads.filter(f"n >= {LEAST} and page_id is not null").select("page_id", "url", "digest")
    last = heads.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("size")).filter("size > 1")
    found = join_known(heads, last, "digest").filter("page_id < last.page_id")
    return found.select("page_id", "digest", F.col("last.page_id").alias("refers"), F.col("last.url").alias("refers_url")).distinct()


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as archives below path."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    marked = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")))).join(decisions(pages), ["page_id", "digest"], "left")

    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                out = []
                for row in b.slice(k, 256).to_pylist():
                    n += 1
                    out += records(f"{row['page_id']}/{task}/{n}", row["page_id"], row["url"], (row["html"] or "").encode(), row["refers"], row["refers_url"])
                yield pa.record_batch({"value": pa.array(out, pa.binary())})

    made = marked.select("page_id", "url", "html", "refers", "refers_url").mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest (hex; as stated for revisits), record_id, target_uri, refers_to_uri.

    page_id and refers_to are private fields of write_archives; they are null for archives of other
    writers, whose revisits name the original by refers_to_uri. The parsed records are cut into the shared
    folder, as whole ones and segments go separate ways; without payloads only the segments' bytes are kept there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    shape = "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, record_id string, target_uri string, refers_to_uri string, origin string, number int, total long"
    names = [x.split()[0] for x in shape.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.int64()]

    def number(x):
        return None if x in (None, "") else int(x)

    def named(fields):
        return fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to-target-uri")

    def response(fields, block, kind):
        payload = http_payload(block) if block.startswith(b"HTTP/") and kind == "response" else block
        digest, stated = hashlib.sha1(payload).digest(), sha1_of(fields.get("warc-payload-digest"))
        if stated not in (None, digest) and "warc-truncated" not in fields:
            raise ArchiveError("payload and digest differ")
        return number(fields.get("warc-page-id")), kind, None, payload if payloads else None, len(payload), digest.hex(), *named(fields), None, None, None

    def row(fields, block):
        kind, page = fields.get("warc-type", ""), number(fields.get("warc-page-id"))
        if kind == "revisit":
            size, digest = _LENGTH.search(block.partition(b"\r\n\r\n")[0]), sha1_of(fields.get("warc-payload-digest"))
            return page, kind, number(fields.get("warc-refers-to-page-id")), None, size and int(size[1]), digest and digest.hex(), *named(fields), None, None, None
        if "warc-segment-number" in fields and kind in ("response", "resource", "continuation"):
            origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
            return page, kind, None, block, None, fields.get("warc-payload-digest"), *named(fields), origin, int(fields["warc-segment-number"]), number(fields.get("warc-segment-total-length"))
        return response(fields, block, kind) if kind in ("response", "resource") else None

    def batch(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw = content.as_py()
                stream = io.BufferedReader(Inflated(raw), 1 << 16) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                rows, held = [], 0
                for fields, block in parse(stream):
                    if (found := row(fields, block)) is None:
                        continue
                    rows.append(found)
                    held += len(block)
                    if held > 1 << 24:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    def join(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        block = reassemble([(r["number"], r["total"], r["payload"]) for r in rows])
        first = next(r for r in rows if r["number"] == 1)
        fields = {"warc-page-id": first["page_id"], "warc-payload-digest": first["payload_digest"], "warc-record-id": first["record_id"], "warc-target-uri": first["target_uri"]}
        return pa.Table.from_batches([batch([response(fields, block, first["record_type"])])])

    found = cut(files.mapInArrow(run, shape))
    whole = found.filter("origin is null")
    parts = found.filter("origin is not null").groupBy("origin").applyInArrow(join, shape)
    return whole.unionByName(parts).drop("origin", "number", "total")


class Inflated(io.RawIOBase):
    """A gzip byte string as a stream, inflated piece by piece; members may follow one another."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.z, self.rest = memoryview(raw), 0, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, into):
        out = b""
        while not out:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.z.unconsumed_tail or self.rest or self.raw[self.at : self.at + 65536]
            if not len(data):
                return 0
            if not self.z.unconsumed_tail and not self.rest:
                self.at += len(data)
            self.rest = b""
            out = self.z.decompress(data, len(into))
        into[: len(out)] = out
        return len(out)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from archives written to the shared folder and read back."""
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_archives(pages, path)
    read = read_archives(spark, path, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest AND payload_bytes >= 1000
"""
