"""Operator 12: documents drawn by importance towards a target corpus, over hashed n-grams.

1. Every batch of words interns its runs of 1 to 3 words in an open-addressed table
   (`ngrams.SpanTable`: xxhash64 keys, bytes compared). A slot stores its bucket, the crc32 of
   its bytes modulo `BUCKETS`, and its count; a task adds its counts up by bucket and gives out
   at most one row per bucket, so the corpus counts are `BUCKETS` rows whatever the input.
2. A bucket's gain is the logarithm of its smoothed frequency in the target over that in the
   corpus. A second pass interns again; occurrences take the gain of their slot's bucket, and a
   document's weight is their sum.
3. The score adds Gumbel noise from a hash of doc_id, so the highest scores are a draw without
   replacement. Ranks come from a distributed sort: rows number themselves inside their range
   partition, and the partitions' sizes, one row each, say where each one begins.

Null and blank texts have no features, weight 0, and are never drawn. Equal scores rank by
doc_id; a row without doc_id draws its noise from an empty id and ranks after equal scores. Rows
that repeat a doc_id are documents of their own (rows equal in all but text rank in any order).
Very long texts go through in blocks of words. An empty table gives no rows, an empty target
counts 0 everywhere. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chaintrail.llm.arrow_text import slices, text_bytes, word_bounds
from chaintrail.llm.ngrams import SpanTable, joined_words, runs
from chaintrail.llm.registry import query, table
from chaintrail.operators.skew import broadcast_checked
from chaintrail.session import materialise

BUCKETS, LONGEST, BLOCK_WORDS = 10_000, 3, 65_536

#: Word bytes: digits, letters after folding, and everything beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[128:] = True


def _interned(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, SpanTable]]:
    """For each block of words: (text of each word, text of each occurrence of a run, the runs' table)."""
    buf, offsets = text_bytes(values, lower=True)
    starts, ends = word_bounds(buf, offsets, WORD)
    text = np.searchsorted(offsets, starts, "right") - 1
    for at in range(0, len(starts), BLOCK_WORDS):
        stop = min(at + BLOCK_WORDS, len(starts))
        beyond = min(stop + LONGEST - 1, len(starts))  # runs may end in the next block
        joined, begin, end = joined_words(buf, starts[at:beyond], ends[at:beyond])
        word, _, a, b = runs(begin, end, text[at:beyond], LONGEST, 0, stop - at)
        yield text[at:stop], text[at + word], SpanTable(joined, a, b)


def _slot_buckets(spans: SpanTable, buckets: int) -> np.ndarray:
    used = np.flatnonzero(spans.first >= 0)
    out = np.zeros(len(spans.first), dtype=np.int64)
    out[used] = spans.crcs(used) % np.uint32(buckets)
    return out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of n-grams in column `text`; buckets without any are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, _, spans in _interned(part.column("text")):
                    np.add.at(total, _slot_buckets(spans, buckets), spans.counts())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths, from the counts of corpus and target (at most one row per bucket each)."""
    both = []
    for counts in (corpus, target):
        dense = [0] * buckets
        for bucket, n in counts.collect():
            dense[bucket] = n
        both.append(dense)
    s, t = both
    all_s, all_t = sum(s), sum(t)
    ratios = (((b + 1) * float(all_s + buckets)) / ((a + 1) * float(all_t + buckets)) for a, b in zip(s, t))
    return np.array([int(np.floor(1000 * log(x))) for x in ratios], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, features, weight = (np.zeros(part.num_rows, dtype=np.int64) for _ in range(3))
                for owner, text, spans in _interned(part.column("text")):
                    np.add.at(weight, text, gain[_slot_buckets(spans, buckets)][spans.slot])
                    features += np.bincount(text, minlength=part.num_rows)
                    words += np.bincount(owner, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """`rows` with `rank` (1, 2, 3...) in the given order, without gathering them in one task.

    Ties in all of `order` are broken by place in the input, which also cuts a run of equal rows.
    Only one row per range partition is gathered.
    """
    order = [*order, F.col("_place")]
    sorted_rows = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*order)
    # inside a partition this id counts up from 0; the partition's number stands above bit 33
    numbered = sorted_rows.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    numbered = materialise(numbered.withColumn("_part", F.shiftright("_place", 33)), "numbered")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(broadcast_checked(begin), "_part").select(*rows.columns, rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank: `percent` of the documents with at least `least_words` words are ranked."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(weights(docs, gain).withColumn("score", F.col("weight") + noise.cast("long")), "weights")
    enough = ranked(scored.where(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return enough.select(*columns, rank).unionByName(rest.select(*columns, "rank"))


@query("op12_importance_draw")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
