"""Operator 3: benchmark decontamination by latent semantic retrieval.

1. Passages are windows of `2 * TILE` words, one every `TILE` words, over whole texts. Words
   are hashed to `FEATURES` columns and weighted by inverse document frequency over all passages.
2. A distributed randomised singular value decomposition of the TF-IDF passages: tasks sum
   A'(A G) for a Gaussian G, the driver orthonormalises it to Q, tasks sum (A Q)'(A Q), and its
   eigenvectors turn Q to the right singular vectors. Only matrices of FEATURES x RANK meet. All
   passages are read for the axes, and all are indexed.
3. Passages and benchmark passages meet in the latent space, each direction scaled by its
   singular value; pairs with a cosine of `CANDIDATE` or more are candidates, without a cap.
4. Candidates whose surroundings hold too few of the item's words go, counted for all of a batch at
   once. The text around the others is compared with the whole item: the longest common
   subsequence of words, as a share of the item, and the share of the item's answer that is
   there. The answer is the item's `answer` column, or else its rarest quarter of words. An item
   is found at LCS >= `COPIED`, or at LCS >= `PARAPHRASED` with `ANSWERED` of the answer.

The benchmark is the stated query set: it goes through in blocks of `BLOCK_ITEMS` items, each
broadcast to a pass over all documents.

Null and empty texts, and texts without a word, are clean; items without a word match nothing.
Of several items in a document the highest LCS counts, then the smallest item_id. Repeated
rows are judged alike, empty tables are fine on either side; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.llm.arrow_text import slices, text_bytes, word_bounds, word_counts, word_hashes
from chaintrail.llm.registry import query, table
from chaintrail.session import materialise

FEATURES, RANK, TILE = 8192, 96, 12
CANDIDATE, COPIED, PARAPHRASED, ANSWERED = 0.4, 0.8, 0.6, 0.7
BLOCK_ITEMS = 2000
#: Tiles whose latent vectors are in memory at once.
CHUNK_TILES = 4096
#: Sums that meet in one group.
FAN = 64
#: Bounds of the sample that the axes were fitted on before; they bound nothing now, a test still sets them.
SAMPLE_TILES, SAMPLE_TEXTS = 200_000, 4_000
#: Rows that are added up for one key at a time. Text that is cut into words at once: what is made on the way stays in the cache.
RUN, SLICE_BYTES = 16, 250_000
#: Of a cut's words, those that occur more often than `FREQUENT` times are added up by one product, `COLUMNS` of them at most.
FREQUENT, COLUMNS = 150, 32
#: Candidates whose words are counted at once.
PAIRS = 4_000
#: Cells of the table of words by items in a block.
BLOCK_CELLS = 16_000_000

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, first word of each text with the total at the end)."""
    buf, offsets = text_bytes(values, lower=True)
    starts, ends = word_bounds(buf, offsets, _WORD)
    return word_hashes(buf, starts, ends), word_counts(starts, offsets)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)


def tiles(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of every tile, text of every tile); texts without words have none."""
    n = np.diff(at)
    count = -(-n // TILE)
    text = np.repeat(np.arange(len(n)), count)
    order = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return at[:-1][text] + TILE * order, text


def _chunks(at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts of the tiles of a batch: (first word, last word, tile starts from there, texts).

    Neighbouring cuts share a tile, so that no window is lost between them.
    """
    starts, text = tiles(at)
    for a in range(0, len(starts), CHUNK_TILES):
        b = min(a + CHUNK_TILES + 1, len(starts))
        end = int(starts[b]) if b < len(starts) else int(at[-1])
        yield int(starts[a]), end, starts[a:b] - starts[a], text[a:b]


def windows(text: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first tile, second tile) of each passage; a text of one tile is a passage with that tile twice (-1).

    `last` tells that no tile follows; else the last tile belongs to the next cut.
    """
    same = np.zeros(len(text), dtype=bool)
    same[:-1] = text[1:] == text[:-1]
    begins = np.ones(len(text), dtype=bool)
    begins[1:] = text[1:] != text[:-1]
    alone = begins & ~same
    if not last:
        alone[-1] = False
    first = np.flatnonzero(same | alone)
    return first, np.where(same[first], first + 1, -1)


def tile_words(bucket: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Columns of each tile's words, one row per tile; places beyond a short tile hold FEATURES."""
    out = np.full((len(starts), TILE), FEATURES, dtype=np.int64)
    lengths = np.diff([*starts, len(bucket)])
    place = np.arange(len(bucket)) - np.repeat(starts, lengths)
    out[np.repeat(np.arange(len(starts)), lengths), place] = bucket
    return out


def project(bucket: np.ndarray, starts: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum of the basis rows of each tile's words, one place in the tiles at a time."""
    held = tile_words(bucket, starts)
    rows = np.concatenate([basis, np.zeros((1, basis.shape[1]), basis.dtype)])
    out = np.take(rows, held[:, 0], axis=0)
    more = np.empty_like(out)
    for j in range(1, TILE):
        np.take(rows, held[:, j], axis=0, out=more, mode="clip")
        out += more
    return out


def group_sums(values: np.ndarray, index: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sum of values[index] of each); `key` ascends.

    Runs of at most `RUN` rows of a key are added up place by place, then their sums in the same way.
    """
    while len(key):
        begins = np.ones(len(key), dtype=bool)
        begins[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(begins)
        place = np.arange(len(key)) - np.repeat(first, np.diff([*first, len(key)]))
        head = np.flatnonzero(place % RUN == 0)
        n = np.diff([*head, len(key)])
        order = np.argsort(-n, kind="stable")
        at, longer = head[order], len(head) - np.cumsum(np.bincount(n, minlength=RUN + 1))
        total = np.take(values, index[at], axis=0)
        more = np.empty_like(total)
        for j in range(1, n.max()):
            here = more[: longer[j]]
            np.take(values, index[at[: longer[j]] + j], axis=0, out=here, mode="clip")
            total[: longer[j]] += here
        values = np.take(total, np.argsort(order), axis=0)
        key, index = key[head], np.arange(len(head))
        if len(first) == len(head):
            break
    return key, values


def word_sums(values: np.ndarray, tile: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, sum of values[tile] over the words of each), in two parts without a common bucket."""
    count = np.bincount(bucket, minlength=FEATURES)
    often = np.argsort(-count, kind="stable")[:COLUMNS]
    often = often[count[often] > FREQUENT]
    column = np.full(FEATURES, -1)
    column[often] = np.arange(len(often))
    at = column[bucket]
    if len(often):
        here = at >= 0
        copies = np.bincount(at[here] * len(values) + tile[here], minlength=len(often) * len(values))
        yield often, copies.reshape(len(often), -1).astype(np.float32) @ values
    rest = np.flatnonzero(at < 0)
    if len(rest):
        order = rest[np.argsort(bucket[rest].astype(np.uint16), kind="stable")]
        yield group_sums(values, tile[order], bucket[order])


def _passages(at: np.ndarray, bucket: np.ndarray, basis: np.ndarray):
    """For each cut: (first word, end, tile starts, text of tile, first and second tile, latent passages)."""
    cuts = list(_chunks(at))
    for i, (a, b, starts, text) in enumerate(cuts):
        # a cut that begins with a tile already used alone in the one before starts no text of its own
        first, second = windows(text, i + 1 == len(cuts))
        if i and len(first) and first[0] == 0 and second[0] == -1 and cuts[i - 1][3][-2:][0] == text[0]:
            first, second = first[1:], second[1:]
        tile = project(bucket[a:b], starts, basis)
        both = tile[first]
        both[second >= 0] += tile[second[second >= 0]]
        yield a, b, starts, text, first, second, both


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")


def _summed(docs: DataFrame, size: int, add) -> np.ndarray:
    """Sum over all tasks of a float vector of fixed `size`, in small pieces, by a tree of partition numbers.

    A group holds `FAN` pieces at most, whatever the number of tasks, and a round costs a `FAN`th of the one
    before; the driver adds up one vector for every 262,144 tasks.
    """
    piece = 8192

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                hashes, at = words(part.column("text"))
                if len(hashes):
                    add(total, buckets(hashes), at)
        salt = TaskContext.get().partitionId() // FAN
        data = [total[i : i + piece].astype("<f8").tobytes() for i in range(0, size, piece)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(data)), pa.int64()), pa.array([salt] * len(data), pa.int64()), pa.array(data, pa.binary())],
            ["piece", "salt", "data"],
        )

    def join(g: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<f8") for x in sorted(g["data"])], axis=0)
        return pd.DataFrame({"piece": g["piece"].iloc[:1], "salt": g["salt"].iloc[:1] // FAN, "data": [total.tobytes()]})

    schema = "piece long, salt long, data binary"
    parts = docs.mapInArrow(run, schema)
    for _ in range(3):
        parts = parts.groupBy("piece", "salt").applyInPandas(join, schema)
    rows = parts.collect()
    total = np.zeros(-(-size // piece) * piece)
    for r in sorted(rows, key=lambda r: (r.piece, r.salt)):
        data = np.frombuffer(r.data, "<f8")
        total[r.piece * piece : r.piece * piece + len(data)] += data
    return total[:size]


@dataclass
class Space:
    idf: np.ndarray  # FEATURES
    basis: np.ndarray  # FEATURES x RANK, with idf and singular values inside
    values: np.ndarray  # singular values


def latent_space(docs: DataFrame) -> Space:
    """Inverse document frequencies and a randomised SVD, both over all passages, in three passes."""
    rows = _texts(docs)

    def count(total: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> None:
        starts, _ = tiles(at)
        held = np.sort(tile_words(bucket, starts).astype(np.int32), axis=1)
        once = np.ones(held.shape, dtype=bool)
        once[:, 1:] = held[:, 1:] != held[:, :-1]
        total[:FEATURES] += np.bincount(held[once], minlength=FEATURES + 1)[:FEATURES]
        total[FEATURES] += len(starts)

    df = _summed(rows, FEATURES + 1, count)
    idf = np.log((1 + df[FEATURES]) / (1 + df[:FEATURES]))
    g = (np.random.default_rng(3).normal(size=(FEATURES, RANK)) * idf[:, None]).astype(np.float32)
    spread = docs.sparkSession.sparkContext.broadcast(g)

    def ranged(total: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> None:
        out = total.reshape(FEATURES, RANK)
        for a, b, starts, _, first, second, y in _passages(at, bucket, spread.value):
            # each word meets the passages its tile is in
            back = np.zeros((len(starts), RANK), np.float32)
            back[first] += y
            back[second[second >= 0]] += y[second >= 0]
            here = bucket[a:b]
            tile = np.repeat(np.arange(len(starts)), np.diff([*starts, b - a]))
            for present, sums in word_sums(back, tile, here):
                out[present] += sums

    sketch = _summed(rows, FEATURES * RANK, ranged).reshape(FEATURES, RANK) * idf[:, None]
    q, _ = np.linalg.qr(sketch)
    turned = docs.sparkSession.sparkContext.broadcast((q * idf[:, None]).astype(np.float32))

    def gram(total: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> None:
        for *_, y in _passages(at, bucket, turned.value):
            total += (y.T @ y).astype(np.float64).ravel()

    squares, vectors = np.linalg.eigh(_summed(rows, RANK * RANK, gram).reshape(RANK, RANK))
    values = np.sqrt(np.maximum(squares, 0))
    scale = np.where(values > 1e-6 * max(values.max(), 1e-30), 1 / np.maximum(values, 1e-30), 0)
    scale *= values.max()
    return Space(idf, (idf[:, None] * (q @ vectors) * scale).astype(np.float32), values)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one row of bits at a time."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = row & places.get(x, 0)
        if m:
            row = ((row + m) | (row - m)) & full
    return len(a) - bin(row).count("1")


@dataclass
class Items:
    ids: np.ndarray
    hashes: list[list[int]]
    answers: list[set[int]]
    passages: np.ndarray  # unit latent vectors
    item: np.ndarray  # index of each passage's item
    begin: np.ndarray  # first word of the passage in its item
    vocabulary: np.ndarray  # hashes of all words of the items, ascending
    copies: np.ndarray  # how often each item (row) holds each of them (column)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def prepare(rows: list[tuple], space: Space) -> Items:
    """`rows`: (item_id, text, answer or None)."""
    hashes, at = words(pa.array([t for _, t, _ in rows], pa.string()))
    bucket = buckets(hashes)
    per_item = [hashes[a:b].tolist() for a, b in zip(at, at[1:])]
    answers = []
    for (_, _, answer), own in zip(rows, per_item):
        if answer:
            answers.append(set(words(pa.array([answer]))[0].tolist()))
        else:
            distinct = sorted(set(own), key=lambda h: (-space.idf[(h >> 20) & (FEATURES - 1)], h))
            answers.append(set(distinct[: -(-len(distinct) // 4)]))
    vectors, item, begin = [np.zeros((0, RANK), np.float32)], [np.zeros(0, int)], [np.zeros(0, int)]
    for a, _, starts, text, first, _, y in _passages(at, bucket, space.basis):
        vectors.append(y)
        item.append(text[first])
        begin.append(a + starts[first] - at[text[first]])
    vocabulary, column = np.unique(hashes, return_inverse=True)
    copies = np.zeros((len(rows), len(vocabulary)), dtype=np.int16)
    np.add.at(copies, (np.repeat(np.arange(len(rows)), np.diff(at)), column), 1)
    ids = np.array([i for i, _, _ in rows])
    return Items(ids, per_item, answers, _unit(np.concatenate(vectors)), np.concatenate(item), np.concatenate(begin), vocabulary, copies)


def shared_words(hashes: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """For each (word range of a text, item): how many of the item's words, repeats counted, are in the range.

    A word counts at its first place in the range: where the place before of the same word lies outside.
    """
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    column = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    known = np.flatnonzero(items.vocabulary[column] == hashes)
    column, text = column[known], text[known]
    order = np.argsort(text * len(items.vocabulary) + column, kind="stable")
    before = np.full(len(known), -1)
    same = (text[order][1:] == text[order][:-1]) & (column[order][1:] == column[order][:-1])
    before[order[1:][same]] = known[order[:-1][same]]
    first, last = np.searchsorted(known, start), np.searchsorted(known, stop)
    out = np.zeros(len(start), dtype=np.int64)
    flat, column, before = items.copies.ravel(), column.astype(np.int32), before.astype(np.int32)
    filled = np.flatnonzero(last > first)
    for a in range(0, len(filled), PAIRS):
        some = filled[a : a + PAIRS]
        n = last[some] - first[some]
        ends = np.cumsum(n)
        place = np.arange(ends[-1], dtype=np.int32) - np.repeat((ends - n - first[some]).astype(np.int32), n)
        row = np.repeat((item[some] * len(items.vocabulary)).astype(np.int32), n)
        held = flat[row + column[place]]
        held *= before[place] < np.repeat(start[some].astype(np.int32), n)
        out[some] = np.add.reduceat(held, ends - n, dtype=np.int32)
    return out


def candidates(hashes: np.ndarray, at: np.ndarray, space: Space, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, first word where the item would begin) of passages near in the latent space, once per tile."""
    found = []
    for a, _, starts, text, first, _, y in _passages(at, buckets(hashes), space.basis):
        p, q = np.divmod(np.flatnonzero(_unit(y) @ items.passages.T >= CANDIDATE), len(items.passages))
        found.append((text[first[p]], items.item[q], a + starts[first[p]] - items.begin[q]))
    if not found:
        return (np.zeros(0, int),) * 3
    doc, item, begin = (np.concatenate(x) for x in zip(*found))
    tile = begin // TILE
    key = (doc * len(items.ids) + item) * (int(tile.max()) - int(tile.min()) + 1) + tile - tile.min() if len(doc) else doc
    once = np.unique(key, return_index=True)[1]
    return doc[once], item[once], begin[once]


def judge(values: pa.Array, space: Space, items: Items) -> list[tuple[int | None, float]]:
    """(item_id, LCS share) of each text's best item, or (None, 0.0)."""
    out: list[tuple[int | None, float]] = [(None, 0.0)] * len(values)
    hashes, at = words(values)
    if not len(items.passages) or not len(hashes):
        return out
    doc, item, begin = candidates(hashes, at, space, items)
    length = np.array([len(own) for own in items.hashes])[item]
    slack = TILE + length // 4
    start, stop = np.maximum(at[doc], begin - slack), np.minimum(at[doc + 1], begin + length + slack)
    enough = np.flatnonzero(shared_words(hashes, at, start, stop, item, items) >= PARAPHRASED * length)
    for d, i, a, b in zip(*(x[enough].tolist() for x in (doc, item, start, stop))):
        own, region = items.hashes[i], hashes[a:b].tolist()
        share = lcs_length(own, region) / len(own)
        answered = len(items.answers[i].intersection(region)) >= ANSWERED * len(items.answers[i])
        if share >= COPIED or (share >= PARAPHRASED and answered):
            best_id, best = out[d]
            if share > best or (share == best and items.ids[i] < best_id):
                out[d] = (int(items.ids[i]), share)
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The benchmark in order of item_id, in blocks of at most `BLOCK_ITEMS` items and, by their words, `BLOCK_CELLS` cells."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer).distinct().orderBy("item_id", "text")
    block: list[tuple] = []
    held = 0
    for r in rows.toLocalIterator():
        own = len(r["text"].split())
        if block and (len(block) == BLOCK_ITEMS or (held + own) * (len(block) + 1) > BLOCK_CELLS):
            yield block
            block, held = [], 0
        block.append(tuple(r))
        held += own
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_id (null if clean), lcs (share of the item's words in common order)."""
    space = latent_space(docs)
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    frame = frame.withColumn("item_id", F.lit(None).cast("long")).withColumn("lcs", F.lit(0.0))
    for number, block in enumerate(_blocks(benchmark)):
        if number:
            frame = materialise(frame, "decontaminated-block")
        spread = context.broadcast((space, prepare(block, space)))

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, limit=SLICE_BYTES):
                    now = judge(part.column("text"), *spread.value)
                    old = zip(part.column("item_id").to_pylist(), part.column("lcs").to_pylist())
                    # blocks come in order of item_id: an equal share stays with the earlier
                    best = [n if n[1] > o[1] else o for n, o in zip(now, old)]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("doc_id", "text")), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.float64())],
                        ["doc_id", "text", "item_id", "lcs"],
                    )

        frame = frame.mapInArrow(run, f"doc_id {kind}, text string, item_id long, lcs double")
    return frame.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "lcs")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` that hold no benchmark item, columns as they are."""
    space = latent_space(docs)
    frame = docs
    for number, block in enumerate(_blocks(benchmark)):
        if number:
            frame = materialise(frame, "decontaminated-block")
        spread = docs.sparkSession.sparkContext.broadcast((space, prepare(block, space)))

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, limit=SLICE_BYTES):
                    found = judge(part.column("text"), *spread.value)
                    yield part.filter(pa.array([item is None for item, _ in found], pa.bool_()))

        frame = frame.mapInArrow(run, docs.schema)
    return frame


@query("op3_benchmark_latent")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
