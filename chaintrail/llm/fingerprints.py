"""Operator 11: document fingerprints by one-permutation MinHash with optimal densification.

1. Every shingle of a text is hashed once. The top bits of the hash pick one of `bins` bins, the
   bin keeps its smallest hash.
2. An empty bin takes the value of an occupied one: it probes the bins in a random order of its
   own, the same for all documents, and stops at the first occupied bin. Probes of two
   documents agree as often as their sets do, which keeps the estimate unbiased.
3. Every bin hashes its value once more with a salt of its own and stores the lowest `bits`
   bits, packed: 256 bytes a document by default. Different values agree by chance once in
   2 ** bits, which `likeness` removes.

Words are those of the near-duplicate operators (A-Z folded, cut at ASCII spaces), shingles have
five of them; a shorter text is one shingle. A text without words has an empty fingerprint:
it is like another empty one (1) and like nothing else (0). Long texts are read whole.

`neighbours` compares each document with an edited text and with the next document in the order
of doc_id. Rows without doc_id come last, rows of one doc_id are ordered by a hash of their
texts, equal rows stand next to each other, and the last row is followed by the first. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chaintrail.llm.arrow_text import SHINGLE_WEIGHTS, mix, slices, text_bytes, word_bounds, word_counts, word_hashes
from chaintrail.llm.registry import query, table
from chaintrail.session import materialise

SHINGLE, BINS, BITS = 5, 512, 4
#: Texts whose bins are held at a time.
TEXTS = 1000
EMPTY = np.uint64(2**64 - 1)


def shingle_hashes(values: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every k-word shingle, repeats included."""
    buf, offsets = text_bytes(values, lower=True)
    starts, ends = word_bounds(buf, offsets)
    words = word_hashes(buf, starts, ends)
    at = word_counts(starts, offsets)
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero(text[: len(words) - k + 1] == text[k - 1 :]) if len(words) >= k else np.zeros(0, dtype=np.int64)
    rolled = np.full(len(whole), k, dtype=np.uint64)
    for j in range(k):
        rolled += words[whole + j] * SHINGLE_WEIGHTS[j]
    short = np.flatnonzero((n > 0) & (n < k))
    alone = n[short].astype(np.uint64)
    for j in range(k - 1):
        there = n[short] > j
        alone[there] += words[at[short[there]] + j] * SHINGLE_WEIGHTS[j]
    return mix(np.concatenate([rolled, alone])), np.concatenate([text[whole], short])


class Fingerprinter:
    """Fingerprints of batches of texts; `bins` is a power of two, `bits` divides 8."""

    def __init__(self, k: int = SHINGLE, bins: int = BINS, bits: int = BITS):
        self.k, self.bins, self.bits = k, bins, bits
        rng = np.random.default_rng(11)
        self.salts = rng.integers(0, 2**63, bins, dtype=np.uint64)
        self.probes = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int16 if bins <= 2**15 else np.int32)

    def minima(self, values: pa.Array) -> np.ndarray:
        """Smallest hash of every bin of every text, `EMPTY` where there is none."""
        hashes, text = shingle_hashes(values, self.k)
        out = np.full(len(values) * self.bins, EMPTY, dtype=np.uint64)
        shift = np.uint64(64 - self.bins.bit_length() + 1)
        np.minimum.at(out, text * self.bins + (hashes >> shift).astype(np.int64), hashes)
        return out.reshape(len(values), self.bins)

    def densify(self, minima: np.ndarray) -> np.ndarray:
        """Fill the empty bins of texts that have any shingle."""
        occupied = minima != EMPTY
        out = minima.copy()
        text, gap = np.nonzero(~occupied & occupied.any(axis=1)[:, None])
        for probe in range(self.bins):
            if not len(text):
                break
            donor = self.probes[gap, probe]
            hit = occupied[text, donor]
            out[text[hit], gap[hit]] = minima[text[hit], donor[hit]]
            text, gap = text[~hit], gap[~hit]
        return out

    def __call__(self, values: pa.Array) -> list[bytes]:
        """Packed fingerprint of each text, b'' for texts without words."""
        return [mark for at in range(0, len(values), TEXTS) for mark in self._packed(values.slice(at, TEXTS))]

    def _packed(self, values: pa.Array) -> list[bytes]:
        minima = self.minima(values)
        filled = (minima != EMPTY).any(axis=1)
        # salted by bin, or two values copied to many bins would agree by chance in all of them
        low = (mix(self.densify(minima) ^ self.salts) & np.uint64(2**self.bits - 1)).astype(np.uint8)
        per_byte = 8 // self.bits
        shifts = (np.arange(per_byte, dtype=np.uint8) * self.bits).astype(np.uint8)
        packed = np.bitwise_or.reduce(low.reshape(len(low), -1, per_byte) << shifts, axis=2)
        return [row.tobytes() if ok else b"" for row, ok in zip(packed, filled)]

    def likeness(self, a: list[bytes], b: list[bytes]) -> np.ndarray:
        """Estimated Jaccard similarity of each pair, 0 to 1."""
        out = np.array([float(x == y) for x, y in zip(a, b)])
        some = [i for i, (x, y) in enumerate(zip(a, b)) if x and y]
        if some:
            left, right = (np.frombuffer(b"".join(s[i] for i in some), dtype=np.uint8).reshape(len(some), -1) for s in (a, b))
            differ, mask = left ^ right, np.uint8(2**self.bits - 1)
            same = sum(((differ >> np.uint8(s)) & mask == 0).sum(axis=1) for s in range(0, 8, self.bits)) / self.bins
            chance = 2.0**-self.bits
            out[some] = np.clip((same - chance) / (1 - chance), 0, 1)
        return out


def fingerprints(docs: DataFrame, k: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, fingerprint (binary) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(k, bins, bits)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                chars = [len(t or "") for t in texts.to_pylist()]
                columns = [part.column("doc_id"), pa.array(chars, pa.int64()), pa.array(make(texts), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint binary")


def _edited(own: str, following: str) -> str:
    """`own` with its last quarter replaced by as much of the beginning of `following`."""
    quarter = len(own) // 4
    return own[: len(own) - quarter] + following[:quarter]


_PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(make: Fingerprinter, ids: list, texts: list[str], marks: list[bytes], following: list[str], next_marks: list[bytes]):
    """A batch of results: each text beside the one that follows it."""
    edited = [_edited(a, b) for a, b in zip(texts, following)]
    edited_marks = make(pa.array(edited, pa.string()))
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(marks, pa.binary()),
        pa.array(edited_marks, pa.binary()),
        pa.array(make.likeness(marks, edited_marks)),
        pa.array(make.likeness(marks, next_marks)),
    ]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays(columns, names)


def neighbours(docs: DataFrame, k: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, into ranges of doc_id, and each partition walks its sorted rows with
    the row before in hand. The last row of a partition waits for the first of the next one:
    only these two texts of each partition are written and joined.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held, part_id = Fingerprinter(k, bins, bits), None, None

        def edge(kind: str, row: tuple) -> pa.RecordBatch:
            columns = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            columns[0], columns[3] = pa.array([row[0]], pa.int64()), pa.array([row[2]], pa.binary())
            more = [pa.array([kind]), pa.array([part_id], pa.int32()), pa.array([row[1]], pa.string())]
            return pa.RecordBatch.from_arrays(columns + more, [*names, "edge", "part", "text"])

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            for some in slices(batch):
                ids = some.column("doc_id").to_pylist()
                texts = [t or "" for t in some.column("text").to_pylist()]
                marks = make(some.column("text"))
                if held is None:
                    part_id = some.column("part")[0].as_py()
                    yield edge("first", (ids[0], texts[0], marks[0]))
                else:
                    ids, texts, marks = [held[0], *ids], [held[1], *texts], [held[2], *marks]
                held = (ids[-1], texts[-1], marks[-1])
                if len(ids) > 1:
                    done = _compared(make, ids[:-1], texts[:-1], marks[:-1], texts[1:], marks[1:])
                    n = done.num_rows
                    more = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())]
                    yield pa.RecordBatch.from_arrays(done.columns + more, [*names, "edge", "part", "text"])
        if held is not None:
            yield edge("last", held)

    order = [F.asc_nulls_last("doc_id"), F.col("mark"), F.col("place")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # `place` cuts a run of equal rows; their order among themselves does not show in the result
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))
    walked = materialise(dealt.mapInArrow(walk, _PAIR + ", edge string, part int, text string"), "walked")

    # one row per partition: its successor is the next partition that has rows, the last one's is the first
    parts = walked.where("edge = 'first'").select("part")
    ordered = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(ordered), F.first("part").over(ordered))
    after = parts.select("part", after.alias("after"))
    last = walked.where("edge = 'last'").select("part", "doc_id", "text", "fingerprint")
    first = walked.where("edge = 'first'").select(
        F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")
    )
    seams = last.join(after, "part").join(first, "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(k, bins, bits)
        for batch in batches:
            for some in slices(batch):
                get = lambda name: some.column(name).to_pylist()
                yield _compared(make, get("doc_id"), get("text"), get("fingerprint"), get("next_text"), get("next_fingerprint"))

    seams = seams.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    inner = walked.where("edge IS NULL").drop("edge", "part", "text")
    return inner.unionByName(seams.mapInArrow(close, _PAIR))


@query("op11_one_permutation")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(table(spark, sf_dir, "documents"))
    for name in ("fingerprint", "edited_fingerprint"):
        rows = rows.withColumn(name, F.lower(F.hex(name)))
    return rows
