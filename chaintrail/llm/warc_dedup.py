"""Operator 4: WARC archives without repeated payloads.

Digests are taken where the pages are read; only headers (id, digest, length) are shuffled by
digest. The record with the largest id of each payload stays a response, the others become
revisits that refer to it. Archives are written by Spark's text writer, one gzip stream of
records per task: a row is a record without its closing blank lines, which the writer adds as
its line separator. That works on any file system Spark can write to.

Null payloads count as empty, and payloads under `min_bytes` are never revisits. A null url
gives no target header; control characters and spaces in a url are percent-encoded in it. A record's id
holds its page_id and its digest. Rows that repeat a page_id each become a record: with other
payloads each refers to the response of its own payload, and rows equal in both are one
record written twice. A null page_id is a response with an empty id and is read back as null. Other
columns are not read. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.llm.registry import query, table
from chaintrail.session import materialise, new_scratch

#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows per archive: keeps a file well below what one task can hold when it is read.
RECORDS_PER_FILE = 4000
READ_BYTES = 1 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits at a time, as SQL functions."""
    digits = F.sha1(data)
    letters = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(digits, at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record_id(page: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.col("payload_digest"), F.lit(">"))


def _record(kind: str, more: list[Column], body: Column) -> Column:
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    block = F.concat(http, body)
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), _record_id("page_id"),
        F.lit("\r\nWARC-Date: "), F.col("written"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("target")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), *more,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END),
    )
    return F.concat(head, block)


PAYLOAD = ["payload_digest", "payload_bytes"]


def revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, refers_to) of records whose payload a record with a larger id holds."""
    usable = headers.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes))
    first = usable.groupBy(*PAYLOAD).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # one row per digest on one side: adaptive execution can split a hot digest on the other
    return usable.join(first, PAYLOAD).where("page_id <> refers_to").select("page_id", *PAYLOAD, "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    target = F.col("url").cast("string")
    for code in [*range(0x21), 0x7F]:
        target = F.replace(target, F.lit(chr(code)), F.lit(f"%{code:02X}")) if code in (0, 9, 10, 11, 12, 13, 32, 0x7F) else target
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), target.alias("target"), html.alias("html"))
    digest = base32_sha1(F.col("html").cast("binary"))
    headers = rows.select("page_id", digest.alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    headers = materialise(headers, "headers")
    rows = rows.withColumns({"payload_digest": digest, "payload_bytes": F.octet_length("html").cast("long")})
    # a page_id may stand for several payloads, and each finds its own response
    rows = rows.join(revisits(headers, min_bytes), ["page_id", *PAYLOAD], "left")
    rows = rows.withColumn("written", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    refers = [F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id("refers_to")]
    record = F.when(F.col("refers_to").isNull(), _record("response", [], F.col("html"))).otherwise(
        _record("revisit", refers, F.lit(""))
    )
    writer = rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Stream:
    """Reads lines and byte counts from one gzip archive, inflated piece by piece."""

    def __init__(self, data: bytes):
        self.rest, self.inflate, self.buffer = memoryview(data), zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                left = self.inflate.unused_data
                if not left:
                    return False
                self.inflate = zlib.decompressobj(31)
                got = self.inflate.decompress(left, READ_BYTES)
            else:
                tail = self.inflate.unconsumed_tail
                if not tail and not len(self.rest):
                    return False
                piece = tail or bytes(self.rest[:READ_BYTES])
                if not tail:
                    self.rest = self.rest[READ_BYTES:]
                got = self.inflate.decompress(piece, READ_BYTES)
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        out, self.buffer = self.buffer[:size], self.buffer[size:]
        return out


def _fields(head: bytes) -> dict[bytes, bytes]:
    return dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])


def parse_archive(data: bytes) -> Iterator[tuple]:
    """(page_id, type, refers_to, url, payload bytes, digest, payload) of each record; payloads are verified."""
    stream, mark = _Stream(data), END.encode()
    while (head := stream.until(mark)) is not None:
        if not head.startswith(VERSION.encode()):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        block = stream.take(int(fields[b"Content-Length"]))
        if stream.take(len(mark)) != mark:
            raise ValueError("a record is longer than it says")
        http, _, payload = block.partition(mark)
        size = int(_fields(http)[b"Content-Length"])
        digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
        kind = fields[b"WARC-Type"].decode()
        if kind == "response":
            if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError("a payload does not have its digest")
        ids = [fields.get(k, b"").removeprefix(b"<urn:page:").partition(b":")[0] for k in (b"WARC-Record-ID", b"WARC-Refers-To")]
        own, refers = (int(x) if x else None for x in ids)
        url = fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None
        yield own, kind, refers, url, size, digest, payload if kind == "response" else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, url, payload_bytes, payload_digest and, if asked for, payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload"]
        width = 7 if payloads else 6

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], types[i]) for i in range(width)]
            return pa.RecordBatch.from_arrays(columns, names[:width])

        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for row in parse_archive(content.as_py()):
                    rows.append(row)
                    if len(rows) == 256:
                        yield table_of(rows)
                        rows = []
                yield table_of(rows)

    schema = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema + (", payload binary" if payloads else ""))


_B32 = " || ".join(
    f"substr('{BASE32}', 1 + (('0x' || substr(d, {at}, 5))::BIGINT >> {s} & 31)::INT, 1)" for at in range(1, 41, 5) for s in (15, 10, 5, 0)
)
_ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, {_B32} AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM q"""


@query("op4_warc_revisits", _ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
