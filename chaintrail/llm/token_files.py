"""Operator 6: token ids in binary files of compressed bit or byte planes.

Documents are dealt by ranges of doc_id and sorted, so that the files hold them in ascending
order. A file is a row of chunks; each chunk is a head of fixed size and its body, and ends
with a line feed (Spark's text writer puts it there, which lets any file system hold the files):

    head   4 bytes "CTB1", kind "D" or "I", 3 bytes 0, then four unsigned 64-bit numbers:
           entries, first entry within the file, body length, planes
    I      a block of up to BLOCK token ids. Its planes are zstandard frames, each with its
           length as 32 bits before it: plane p holds byte p (or bit p) of every id
    D      the ids (int64) and token counts (int64) of documents whose last id is in the file
           by then, one zstandard frame

All numbers are little-endian. The chunk index is a table in the folder `_chunk_index` of the files,
written with them: file, kind, position, length, entries, first entry within the file and, of ids,
their place among all ids. `read_ids` finds the files and chunks of a range of ids in it and
opens no others; `read_documents` takes the place of each file from it.

Null texts count as empty and hold the end id alone. Rows that repeat a doc_id are ordered by
a hash of their text, which also lets one doc_id fill several files. A null doc_id comes first.
An empty table writes no chunk. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chaintrail.llm.arrow_text import slices
from chaintrail.llm.registry import query, table
from chaintrail.llm.token_units import UnitEncoder
from chaintrail.session import materialise, new_scratch

MAGIC = b"CTB1"
HEAD = "<4sc3xQQQQ"
HEAD_SIZE = struct.calcsize(HEAD)
BLOCK = 1 << 16
NULL_ID = -(1 << 63)
#: Text bytes of one file, which one task reads whole.
FILE_BYTES = 16 << 20
INDEX, FILES_PER_GROUP = "_chunk_index", 10_000


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """Units are cut at ASCII spaces: the tokenizer drops spaces, and no merge or normal form crosses one."""
    tokenizer = Tokenizer.from_file(path)
    return UnitEncoder(tokenizer, spaced=False, whole=lambda t: "<|" in t)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Plane p holds byte p (or bit p) of all ids."""
    columns = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [columns[:, p].tobytes() for p in range(4)]
    every = np.unpackbits(columns, axis=1, bitorder="little")
    return [np.packbits(every[:, p], bitorder="little").tobytes() for p in range(32)]


def from_planes(planes: list[bytes], entries: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").ravel()
    every = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=entries, bitorder="little") for p in planes], axis=1)
    return np.packbits(every, axis=1, bitorder="little").view("<u4").ravel()


def ids_chunk(ids: np.ndarray, first: int, bits: bool = False) -> bytes:
    packer = zstandard.ZstdCompressor(level=1)
    frames = [packer.compress(p) for p in to_planes(ids, bits)]
    body = b"".join(struct.pack("<I", len(f)) + f for f in frames)
    return struct.pack(HEAD, MAGIC, b"I", len(ids), first, len(body), len(frames)) + body


def docs_chunk(doc_ids: list[int], counts: list[int], first: int) -> bytes:
    body = zstandard.ZstdCompressor(level=1).compress(np.array([doc_ids, counts], dtype="<i8").tobytes())
    return struct.pack(HEAD, MAGIC, b"D", len(doc_ids), first, len(body), 1) + body


def read_chunks(data: bytes) -> Iterator[tuple[str, int, int, int, object]]:
    """(kind, position, length, first entry, content): ids, or (doc ids, token counts)."""
    at, unpacker = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, kind, entries, first, size, planes = struct.unpack_from(HEAD, data, at)
        if magic != MAGIC:
            raise ValueError(f"no chunk at byte {at}")
        start = at + HEAD_SIZE
        if kind == b"I":
            frames, p = [], start
            for _ in range(planes):
                (n,) = struct.unpack_from("<I", data, p)
                frames.append(unpacker.decompress(data[p + 4 : p + 4 + n]))
                p += 4 + n
            content: object = from_planes(frames, entries)
        else:
            content = np.frombuffer(unpacker.decompress(data[start : start + size]), "<i8").reshape(2, -1)
        yield kind.decode(), at, HEAD_SIZE + size, first, content
        at = start + size + 1


def write_files(docs: DataFrame, out: str, tokenizer: str, end_id: int, bits: bool = False) -> None:
    """Encode `text`, append `end_id` to each document and write the files into folder `out`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        rest, written, n_docs = np.zeros(0, dtype=np.uint32), 0, 0
        for batch in batches:
            for part in slices(batch):
                ids, counts = enc.encode(part.column("text"))
                ends = np.cumsum(counts)
                rest = np.concatenate([rest, np.insert(ids, ends, end_id)])
                chunks = []
                while len(rest) >= BLOCK:
                    chunks.append(ids_chunk(rest[:BLOCK], written, bits))
                    rest, written = rest[BLOCK:], written + BLOCK
                doc_ids = [NULL_ID if x is None else x for x in part.column("doc_id").to_pylist()]
                chunks.append(docs_chunk(doc_ids, (counts + 1).tolist(), n_docs))
                n_docs += len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary())], ["chunk"])
        if len(rest):
            yield pa.RecordBatch.from_arrays([pa.array([ids_chunk(rest, written, bits)], pa.binary())], ["chunk"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    session = docs.sparkSession
    files = max(1, -(-size // FILE_BYTES), 2 * session.sparkContext.defaultParallelism)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "place"]
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    chunks = rows.mapInArrow(run, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    chunks.write.option("lineSep", "\n").text(out)
    _placed(_heads(session, out)).write.parquet(f"{out}/{INDEX}")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _heads(spark: SparkSession, folder: str) -> DataFrame:
    """file, kind, position, length, first (entry within the file), entries of every chunk, read off the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                at, rows = 0, []
                raw = data.as_buffer()
                while at < raw.size:
                    _, kind, entries, first, size, _ = struct.unpack_from(HEAD, raw, at)
                    rows.append((file, kind.decode(), at, HEAD_SIZE + size, first, entries))
                    at += HEAD_SIZE + size + 1
                names = ["file", "kind", "position", "length", "first", "entries"]
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return _files(spark, folder).mapInArrow(run, "file string, kind string, position long, length long, first long, entries long")


def _placed(heads: DataFrame) -> DataFrame:
    """`heads` with `start`, the place of a chunk's first id among the ids of all files (null for other chunks).

    Files are numbered in the order of their ranges. Their sizes are added up in groups of `FILES_PER_GROUP`
    files, and the groups' sums before that, so that no task sees all files.
    """
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("long")
    heads = materialise(heads.withColumn("number", number).withColumn("bunch", F.floor(number / FILES_PER_GROUP)), "heads")
    ids = F.when(F.col("kind") == "I", F.col("entries")).otherwise(0)
    files = heads.groupBy("bunch", "number").agg(F.sum(ids).alias("n"))
    before = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = files.withColumn("inside", before(Window.partitionBy("bunch").orderBy("number"))).select("number", "inside", "bunch")
    groups = files.groupBy("bunch").agg(F.sum("n").alias("n"))
    outside = groups.select("bunch", before(Window.orderBy("bunch")).alias("outside"))
    places = inside.join(outside, "bunch").select("number", (F.col("inside") + F.col("outside")).alias("before"))
    start = F.when(F.col("kind") == "I", F.col("before") + F.col("first")).alias("start")
    return heads.join(places, "number").select("file", "kind", "position", "length", "first", "entries", start)


def chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    """file, kind, position, length, first (entry within the file), entries, start: the index stored with the files."""
    return spark.read.parquet(f"{folder}/{INDEX}")


def read_ids(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """(place, ids): the ids from place `start` up to `stop` among all ids, one row for each chunk that holds some.

    Only files with such chunks are opened, and only these chunks are unpacked.
    """
    found = chunk_index(spark, folder).where((F.col("kind") == "I") & (F.col("start") < stop) & (F.col("start") + F.col("entries") > start))
    found = found.groupBy("file").agg(F.collect_list(F.struct("position", "length", "start")).alias("chunks"))
    paths = [f"{folder}/{r['file']}" for r in found.select("file").toLocalIterator()]  # the files asked for
    schema = "place long, ids array<int>"
    if not paths:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, chunks in zip(batch.column("content"), batch.column("chunks").to_pylist()):
                raw = data.as_buffer()
                for c in chunks:
                    piece = raw.slice(c["position"], c["length"]).to_pybytes()
                    ((_, _, _, _, ids),) = read_chunks(piece)
                    a, b = max(start - c["start"], 0), min(stop - c["start"], len(ids))
                    columns = [pa.array([c["start"] + a], pa.int64()), pa.array([ids[a:b].astype(np.int32)], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["place", "ids"])

    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(found, "file").select("content", "chunks").mapInArrow(run, schema)


def _documents_of(chunks: Iterator) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start within the file, ids) in the file's order."""
    have, waiting, start = np.zeros(0, dtype=np.uint32), [], 0
    for kind, _, _, _, content in chunks:
        if kind == "I":
            have = np.concatenate([have, content])
        else:
            waiting += list(zip(*content.tolist()))
        done = 0
        at = 0
        while done < len(waiting) and at + waiting[done][1] <= len(have):
            doc, n = waiting[done]
            yield doc, start, have[at : at + n]
            start, at, done = start + n, at + n, done + 1
        have, waiting = have[at:], waiting[done:]
    if waiting or len(have):
        raise ValueError("a file ends inside a document")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: 6 if with_ids else 5]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32())]

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows = []
                for doc, start, ids in _documents_of(read_chunks(data.as_py())):
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((file, None if doc == NULL_ID else doc, start, len(ids), crc, ids.astype(np.int32)))
                    if len(rows) == 1000:
                        yield table_of(rows)
                        rows = []
                yield table_of(rows)

    schema = "file string, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = _files(spark, folder).mapInArrow(run, schema)
    ids = chunk_index(spark, folder).where("kind = 'I'")
    before = ids.groupBy("file").agg(F.min(F.col("start") - F.col("first")).alias("before"))
    out = rows.join(before, "file").withColumn("start", F.col("at") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_scratch(spark, "token-files")
    write_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, out, with_ids=False)
