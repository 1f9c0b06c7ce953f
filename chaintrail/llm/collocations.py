"""Operator 13: phrase collocations, found by mergeable Misra-Gries summaries and counted exactly.

1. Runs of 1 to `longest` words are hashed together with their language. A task keeps counters by
   hash and gives them out, packed, as one summary per hash partition whenever it holds
   `HELD` of them. Every hash partition gets its total mass first, and merges its summaries
   into one with more counters than mass / threshold: when there are more, the largest one
   that does not fit is taken off all of them. What is taken off a counter in the end is below the
   threshold, so each run that occurs `threshold` times survives.
2. Survivors set bits of a filter of at most `FILTER_BITS` bits (fewer bits per survivor let
   more other runs pass, no less of the survivors). A second pass over the texts counts what
   passes by its bytes, in tables of `ngrams.SpanTable`, and runs below the threshold go.
3. Every phrase meets the counts of the two parts of each cut, and the longer phrases that hold
   it. Frequent parts are split over tasks; the first rows of a language are found in rounds.

Numbers are exact up to a phrase frequency of 10 ** 15. Null and empty texts have no words; a null
language is `und`, which is also what a language of that name is counted under. Rows that repeat are
counted as often as they stand, whatever their doc_id, which is not read. Very long texts go
through in blocks of words. Ties are ordered by frequency and bytes, so results do not
depend on the partitions. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chaintrail.llm.arrow_text import SHINGLE_WEIGHTS, mix, slices, text_bytes, word_bounds, word_hashes
from chaintrail.llm.ngrams import SpanTable, joined_words, runs
from chaintrail.llm.registry import query, table
from chaintrail.operators.skew import HotKeySplit, broadcast_checked
from chaintrail.session import materialise

UNKNOWN = "und"
#: Text per hash partition, which bounds its counters.
PART_BYTES = 128 << 20
#: Occurrences a task gathers before it sorts them, counters and phrases it holds before it gives them out.
GATHERED, HELD, PHRASES = 500_000, 1_000_000, 120_000
FILTER_BITS, BITS_PER_SURVIVOR = 1 << 30, 16
#: Bytes of text and words that are looked at together.
SLICE, BLOCK_WORDS = 500_000, 65_536
#: Rows that look up one part of a phrase in one task; rows of a language that one task ranks.
PART_ROWS, RANK_ROWS = 2_000, 8_000

#: Bytes that end a piece, and bytes of words.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
WORD = ~ENDS
WORD[[9, 32]] = False


def _rows(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    return docs.select(lang, F.col("text").cast("string").alias("text"))


def _words(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, text of each word, piece of each word); pieces are numbered in order."""
    buf, offsets = text_bytes(values, lower=True)
    starts, ends = word_bounds(buf, offsets, WORD)
    text = np.searchsorted(offsets, starts, "right") - 1
    return buf, starts, ends, text, np.cumsum(ENDS[buf])[starts] + text


def _run_hashes(words: np.ndarray, first: np.ndarray, size: int, tongue: np.ndarray | np.uint64) -> np.ndarray:
    """64-bit hashes of the runs of `size` words that begin at `first`."""
    rolled = np.full(len(first), size, dtype=np.uint64) + tongue
    for j in range(size):
        rolled += words[first + j] * SHINGLE_WEIGHTS[j]
    return mix(rolled)


def _tongue(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _place(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash partition, key inside it) of run hashes; keys that meet add up, which lets no run go."""
    return (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(parts), (hashes >> np.uint64(32)).astype(np.uint32)


_SUMMARY = "part long, role int, mass long, ones binary, more binary, counts binary"


def _packed(hashes: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """One mass row and one summary row for each hash partition; counters of 1 are stored without their count."""
    part, key = _place(hashes, parts)
    order = np.lexsort((key, counts > 1, part))
    part, key, counts = part[order], key[order], counts[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
    owner, mass, ones, more, values = [], [], [], [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        split = a + int(np.searchsorted(counts[a:b] > 1, True))
        owner.append(int(part[a]))
        mass.append(int(counts[a:b].sum()))
        ones.append(key[a:split].tobytes())
        more.append(key[split:b].tobytes())
        values.append(counts[split:b].astype(np.int64).tobytes())
    n = len(owner)
    columns = [
        pa.array(owner * 2, pa.int64()),
        pa.array([0] * n + [1] * n, pa.int32()),
        pa.array(mass + [0] * n, pa.int64()),
        *(pa.array([b""] * n + x, pa.binary()) for x in (ones, more, values)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "role", "mass", "ones", "more", "counts"])


def summaries(docs: DataFrame, parts: int, longest: int) -> DataFrame:
    """Packed counters of the runs in each task's texts, one row per hash partition each time a task gives them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        fresh, gathered = [], 0

        def settle():
            if not fresh:
                return held
            keys, counts = np.unique(np.concatenate(fresh), return_counts=True)
            return _tally(np.concatenate([held[0], keys]), np.concatenate([held[1], counts]))

        for batch in batches:
            for some in slices(batch, limit=SLICE):
                buf, starts, ends, text, piece = _words(some.column("text"))
                hashes = word_hashes(buf, starts, ends)
                langs = some.column("lang").to_pylist()
                known = {x: _tongue(x) for x in set(langs)}
                tongue = np.array([known[x] for x in langs], dtype=np.uint64)[text]
                for size in range(1, longest + 1):
                    first = np.arange(max(len(starts) - size + 1, 0))
                    first = first[piece[first] == piece[first + size - 1]]
                    fresh.append(_run_hashes(hashes, first, size, tongue[first]))
                    gathered += len(first)
                if gathered >= GATHERED:
                    held, fresh, gathered = settle(), [], 0
                    if len(held[0]) >= HELD:
                        yield _packed(*held, parts)
                        held = (held[0][:0], held[1][:0])
        held = settle()
        if len(held[0]):
            yield _packed(*held, parts)

    return _rows(docs).mapInArrow(run, _SUMMARY)


class Summary:
    """Misra-Gries summary with a fixed number of counters, fed and merged in bulk."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        self.off = 0  # taken off every counter so far

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = _tally(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(self.keys) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            least = int(np.partition(self.counts, at)[at])
            self.off += least
            left = self.counts > least
            self.keys, self.counts = self.keys[left], self.counts[left] - least

    def survivors(self, threshold: int) -> np.ndarray:
        """Every key that may have been fed `threshold` times."""
        return self.keys[self.counts + self.off >= threshold]


def survivors(packed: DataFrame, threshold: int) -> DataFrame:
    """(part, n, keys): keys of each hash partition that may occur `threshold` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary, waiting, size = None, 0, None, [], 0

        def feed():
            if waiting:
                summary.add(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
                waiting.clear()

        def close():
            feed()
            keys = summary.survivors(threshold)
            columns = [pa.array([part], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "n", "keys"])

        for batch in batches:
            owners, roles, masses = (batch.column(c).to_pylist() for c in ("part", "role", "mass"))
            for i in range(batch.num_rows):
                if owners[i] != part:
                    if summary is not None:
                        yield close()
                    part, mass, summary, size = owners[i], 0, None, 0
                if roles[i] == 0:
                    mass += masses[i]
                    continue
                if summary is None:
                    summary = Summary(mass // threshold + 1)
                ones, more, counts = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                    for c, kind in (("ones", np.uint32), ("more", np.uint32), ("counts", np.int64))
                )
                waiting.append((ones, np.ones(len(ones), dtype=np.int64)))
                waiting.append((more, counts))
                size += len(ones) + len(more)
                if size >= max(summary.capacity, GATHERED):
                    feed()
                    size = 0
            feed()  # what waits is a view of this batch
            size = 0
        if summary is not None:
            yield close()

    rows = packed.repartition("part").sortWithinPartitions("part", "role")
    return rows.mapInArrow(run, "part long, n long, keys binary")


def _filter(kept: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """(bits, bits per hash partition); a key's bit is its remainder inside the partition's segment."""
    total = kept.agg(F.sum("n")).first()[0] or 0
    width = min(max(64, 8 * ceil(BITS_PER_SURVIVOR * total / parts / 8)), max(8, FILTER_BITS // parts // 8 * 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keys in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist()):
                bits = np.zeros(width, dtype=np.uint8)
                bits[np.frombuffer(keys, np.uint32) % np.uint32(width)] = 1
                columns = [pa.array([part], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "bits"])

    out = np.zeros(parts * width // 8, dtype=np.uint8)
    for part, bits in kept.select("part", "keys").mapInArrow(run, "part long, bits binary").collect():
        out[part * width // 8 : (part + 1) * width // 8] = np.frombuffer(bits, np.uint8)
    return out, width


def counted(docs: DataFrame, bits: np.ndarray, width: int, parts: int, longest: int) -> DataFrame:
    """(lang, phrase, f): exact counts of the runs that pass the filter; the empty phrase counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}

        def out():
            langs, phrases = zip(*held)
            columns = [pa.array(langs, pa.string()), pa.array([p.decode() for p in phrases], pa.string()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

        for batch in batches:
            for some in slices(batch, limit=SLICE):
                langs = some.column("lang").to_pylist()
                for lang in set(langs):
                    here = pa.array([x == lang for x in langs])
                    buf, starts, ends, _, piece = _words(some.column("text").filter(here))
                    held[lang, b""] = held.get((lang, b""), 0) + len(starts)
                    for at in range(0, len(starts), BLOCK_WORDS):
                        stop = min(at + BLOCK_WORDS, len(starts))
                        beyond = min(stop + longest - 1, len(starts))
                        cut = slice(at, beyond)
                        hashes = word_hashes(buf, starts[cut], ends[cut])
                        joined, begin, end = joined_words(buf, starts[cut], ends[cut])
                        word, size, a, b = runs(begin, end, piece[cut], longest, 0, stop - at)
                        keys = [_run_hashes(hashes, word[size == n], n, np.uint64(_tongue(lang))) for n in range(1, longest + 1)]
                        part, key = _place(np.concatenate(keys), parts)
                        bit = part.astype(np.int64) * width + key % np.uint32(width)
                        passed = (bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                        spans = SpanTable(joined, a[passed], b[passed])
                        used = np.flatnonzero(spans.first >= 0)
                        for phrase, n in zip(spans.spans(used), spans.counts()[used].tolist()):
                            held[lang, phrase] = held.get((lang, phrase), 0) + n
                        if len(held) >= PHRASES:
                            yield out()
                            held.clear()
        if held:
            yield out()

    return _rows(docs).mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_runs(docs: DataFrame, threshold: int = 10, longest: int = 3) -> DataFrame:
    """(lang, phrase, f): all runs of 1 to `longest` words that occur `threshold` times in a language, and each
    language's number of words under the empty phrase."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    session = docs.sparkSession
    parts = max(ceil(size / PART_BYTES), int(session.conf.get("spark.sql.shuffle.partitions")))
    kept = materialise(survivors(summaries(docs, parts, longest), threshold), "survivors")
    bits, width = _filter(kept, parts)
    return counted(docs, bits, width, parts, longest).where((F.col("f") >= threshold) | (F.col("phrase") == ""))


def _looked_up(rows: DataFrame, key: str, counts: DataFrame, name: str) -> DataFrame:
    """`rows` with the count of the run in column `key`; a run that many rows look up is split."""
    split = HotKeySplit(rows, key, PART_ROWS)
    many, few = split.spread(rows, ["gram", "k"]), split.repeat(counts.select(F.col("gram").alias("_gram"), F.col("f").alias(name)), "_gram")
    return many.join(few, split.on(many, few, "_gram")).select(*rows.columns, name)


def _first_of_language(rows: DataFrame, first: int) -> DataFrame:
    """The first rows of each language with their rank.

    A language is dealt to parts of about `RANK_ROWS` rows, which give on their own first rows only,
    round after round, until what is left of the largest one is as small as a part.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_size"))
    most = sizes.agg(F.max("_size")).first()[0] or 0
    rows = rows.join(broadcast_checked(sizes), "lang")
    part_rows = max(RANK_ROWS, 2 * first)
    while most > part_rows:
        parts = F.ceil(F.col("_size") / part_rows)
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), parts))
        best = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
        rows = rows.withColumn("_best", best).where(F.col("_best") <= first)
        rows = rows.withColumn("_size", F.least(F.col("_size"), parts * first)).drop("_part", "_best")
        most = ceil(most / part_rows) * first
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return rows.drop("_size").withColumn("rank", rank).where(F.col("rank") <= first)


def collocations(docs: DataFrame, threshold: int = 10, longest: int = 3, first: int = 2000, absorbed: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of 2 to `longest` words in each language.

    A phrase goes when a longer one that holds it has at least `absorbed` percent of its frequency.
    """
    gram = F.concat("lang", F.lit("\n"), "phrase")  # no phrase holds a line feed
    runs_ = materialise(frequent_runs(docs, threshold, longest), "frequent-runs")
    words = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    grams = runs_.select("lang", "phrase", "f", gram.alias("gram"), words.alias("words"))
    phrases = grams.where(F.size("words") > 1)

    def piece(a, n):
        return F.concat("lang", F.lit("\n"), F.array_join(F.slice("words", a, n), " "))

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "gram", "k", F.col("f").alias("a"), piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.size("words") - F.col("k")).alias("right")
    )
    cuts = _looked_up(cuts, "left", grams, "l")
    cuts = _looked_up(cuts, "right", grams, "r")
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(a AS {wide}) * cast(a AS {wide}) * 1000000BD) div (cast(l AS {wide}) * cast(r AS {wide}))")
    worst = cuts.withColumn("score", score).groupBy("gram").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = phrases.select("*", F.explode(F.sequence(F.lit(2), F.size("words"))).alias("size")).where(F.col("size") < F.size("words"))
    inside = inside.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    holders = inside.groupBy(piece(F.col("at"), F.col("size")).alias("gram")).agg(F.max("f").alias("longer"))

    left = phrases.select("gram", "lang", "phrase", F.col("f").alias("a")).join(holders, "gram", "left")
    left = left.where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))).join(worst, "gram")
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    n = runs_.where("phrase = ''").select("lang", F.col("f").alias("n"))
    ranked = _first_of_language(materialise(rows, "phrases"), first).join(n, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\n\x0B\x0C\r]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, m, unnest([array_to_string(w[i : i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) AS phrase
  FROM words, (VALUES (1), (2), (3)) s(m)),
counts AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 10),
candidates AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS g FROM counts WHERE m > 1),
parts AS (
  SELECT lang, phrase, m, f AS a, k, array_to_string(g[1 : k], ' ') AS x, array_to_string(g[k + 1 : m], ' ') AS y
  FROM candidates, (VALUES (1), (2)) t(k) WHERE k < m),
cuts AS (
  SELECT p.lang, p.phrase, m, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM parts p JOIN (SELECT lang, phrase AS x, f FROM counts) x USING (lang, x)
               JOIN (SELECT lang, phrase AS y, f FROM counts) y USING (lang, y)),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(g[p : p + 1], ' ') AS phrase, max(f) AS longer
  FROM candidates, (VALUES (1), (2)) t(p) WHERE m = 3 GROUP BY ALL),
left_over AS (
  SELECT w.* FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * w.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
