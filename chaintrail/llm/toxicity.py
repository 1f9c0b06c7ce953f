"""Operator 2: toxic passages as maximum-scoring segments of token log-odds.

Tokens (runs of letters and digits, lower-cased) are hashed to `BUCKETS`. Over all labelled
training rows each bucket's documents are counted by label; log-odds with a Dirichlet prior in
proportion to the bucket's overall count give its score where the log-odds are `SIGNIFICANT`
standard deviations from zero, and every token pays `DRIFT`. Ruzzo and Tompa's linear scan
finds all maximal segments; only tokens of positive score can begin or end one, so it runs over
those, with the tokens between them summed.

A segment's expected number in n tokens is K n exp(-lambda S): lambda solves the score equation
of non-toxic text, K is fitted to the best segments of non-toxic training rows. A document's
score is a logistic function of its best segment's -log of that number and of how many of its
segments are significant, fitted on at most `CALIBRATION_ROWS` labelled training rows.

Null and empty texts have no tokens and get the score of no evidence. Without training rows of
both labels all scores are 0.5. Repeated rows score alike, an empty table gives none; clashing
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.llm.arrow_text import slices, text_bytes, word_bounds, word_hashes
from chaintrail.llm.registry import fold, query, table
from chaintrail.operators.skew import broadcast_checked

BUCKETS, PRIOR, SIGNIFICANT, DRIFT = 1 << 20, 0.1, 3.5, 0.3
CALIBRATION_ROWS, LABEL_ROWS = 10_000, 1_000_000
E_VALUE = 0.01

LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True


def tokens(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(buckets, index of each text's first token and the total, byte starts, byte ends, lower-cased texts)."""
    texts = [x.lower() if x else "" for x in values.to_pylist()]
    buf, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, ends = word_bounds(buf, offsets, LETTERS)
    hashed = (word_hashes(buf, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return hashed, np.searchsorted(starts, offsets), starts - offsets[np.searchsorted(offsets, starts, "right") - 1], ends - starts, texts


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score): Ruzzo and Tompa's scan in linear time."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # start, end, sum before, sum after, nearest earlier segment with a smaller sum before
    for at in np.flatnonzero(scores > 0).tolist():
        new = [at, at + 1, sums[at], sums[at + 1], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, float(b - a)) for s, e, a, b, _ in stack]


@dataclass
class Model:
    scores: np.ndarray
    rate: float  # lambda
    size: float  # K
    weights: np.ndarray  # logistic: intercept, evidence, significant segments

    def passages(self, values: pa.Array) -> Iterator[list[tuple[int, int, float, float]]]:
        """Of each text: byte start and end (in the lower-cased text), score and expected number of its segments."""
        hashed, first, begin, length, _ = tokens(values)
        got = self.scores[hashed] - DRIFT
        hits = np.concatenate([[0], np.cumsum(got > 0)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            found = segments(got[a:b]) if hits[b] > hits[a] else []
            e = [self.size * (b - a) * np.exp(-self.rate * s) for _, _, s in found]
            yield [
                (int(begin[a + i]), int(begin[a + j - 1] + length[a + j - 1]), s, float(x)) for (i, j, s), x in zip(found, e)
            ]

    def features(self, values: pa.Array) -> np.ndarray:
        """Per text: 1, -log expected number of the best segment (0 without one), log of 1 + significant segments."""
        rows = []
        for found in self.passages(values):
            best = min((x for *_, x in found), default=1.0)
            rows.append((1.0, max(0.0, -np.log(max(best, 1e-30))), np.log1p(sum(x <= E_VALUE for *_, x in found))))
        return np.array(rows, dtype=float).reshape(-1, 3)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def _counts(rows: DataFrame) -> DataFrame:
    """(bucket, toxic, other): documents that hold a token of the bucket, by label; bucket -1 counts documents.

    Each task adds its documents up before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                hashed, first, *_ = tokens(part.column("text"))
                label = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(label)), np.diff(first))
                pairs = np.unique(doc * BUCKETS + hashed)
                kind, bucket = label[pairs // BUCKETS], pairs % BUCKETS
                for k in (0, 1):
                    total[k, :BUCKETS] += np.bincount(bucket[kind == k], minlength=BUCKETS)
                    total[k, BUCKETS] += (label == k).sum()
        at = np.flatnonzero(total.any(axis=0))
        names = np.where(at == BUCKETS, -1, at)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total[1, at]), pa.array(total[0, at])], ["bucket", "toxic", "other"])

    sums = rows.mapInArrow(run, "bucket long, toxic long, other long").groupBy("bucket")
    return sums.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _rate(scores: np.ndarray, chances: np.ndarray) -> float:
    """The positive solution of sum(p exp(lambda s)) = 1; p beyond the listed scores is for -DRIFT."""
    rest = max(0.0, 1 - chances.sum())

    def excess(x: float) -> float:
        return float((chances * np.exp(x * scores)).sum() + rest * np.exp(-x * DRIFT) - 1)

    high = 1e-3
    while excess(high) < 0 and high < 50:
        high *= 2
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """`docs`: doc_id, text of the training rows; `labels`: doc_id, toxic. None without both labels."""
    known = labels.where("toxic IN (0, 1)").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").join(broadcast_checked(known, None, LABEL_ROWS), "doc_id")
    rows = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    counts = _counts(rows.select("text", "toxic")).persist()
    total = counts.where("bucket >= 0").agg(F.sum("toxic"), F.sum("other")).first()
    if not total[0] or not total[1]:
        counts.unpersist()
        return None
    n_toxic, n_other = map(float, total)
    a = PRIOR * (F.col("toxic") + F.col("other"))
    mass = PRIOR * (n_toxic + n_other)
    y1, y0 = F.col("toxic") + a, F.col("other") + a
    odds = F.log(y1 / (F.lit(n_toxic + mass) - y1)) - F.log(y0 / (F.lit(n_other + mass) - y0))
    scored = counts.where("bucket >= 0").select("bucket", odds.alias("s"), (y0 / (n_other + mass)).alias("p"), F.sqrt(1 / y1 + 1 / y0).alias("sd"))
    # at most BUCKETS rows, a parameter; significant ones are far fewer
    found = np.array(scored.where(F.abs("s") > SIGNIFICANT * F.col("sd")).select("bucket", "s", "p").collect(), dtype=float).reshape(-1, 3)
    counts.unpersist()
    scores = np.zeros(BUCKETS, dtype=np.float32)
    scores[found[:, 0].astype(int)] = found[:, 1]
    model = Model(scores, _rate(found[:, 1] - DRIFT, found[:, 2]), 1.0, np.zeros(3))
    sampled = rows.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").select("doc_id", "toxic").limit(CALIBRATION_ROWS)
    sampled = rows.join(F.broadcast(sampled.select("doc_id").distinct()), "doc_id", "left_semi")
    return _calibrated(model, sampled)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """Fit K to non-toxic rows, then the logistic weights."""
    spread = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                best, n, e = [], [], []
                for found in spread.value.passages(part.column("text")):
                    best.append(max((s for *_, s, _ in found), default=0.0))
                    e.append([x for *_, x in found])
                _, first, *_ = tokens(part.column("text"))
                n = np.diff(first)
                columns = [part.column("toxic"), pa.array(best, pa.float64()), pa.array(n, pa.int64()), pa.array(e, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["toxic", "best", "n", "e"])

    got = rows.select("text", "toxic").mapInArrow(run, "toxic int, best double, n long, e array<double>").collect()
    label = np.array([r.toxic for r in got], dtype=float)
    best, n = np.array([r.best for r in got]), np.array([r.n for r in got], dtype=float)
    plain = label == 0
    model.size = float(max(plain.sum(), 1) / max((n * np.exp(-model.rate * best))[plain].sum(), 1.0))
    x = []
    for r in got:
        e = [v * model.size for v in r.e]
        x.append((1.0, max(0.0, -np.log(max(min(e, default=1.0), 1e-30))), np.log1p(sum(v <= E_VALUE for v in e))))
    x, w = np.array(x).reshape(-1, 3), np.zeros(3)
    for _ in range(50):  # Newton's method with a weak Gaussian prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - label) + 0.1 * w
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(3), grad)
    model.weights = w
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """key, score, passages (array of byte spans with score and expected number) of (key, text) rows."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                found = list(m.passages(text)) if m else [[]] * len(text)
                x = np.array(
                    [
                        (1.0, max(0.0, -np.log(max(min((e for *_, e in f), default=1.0), 1e-30))), np.log1p(sum(e <= E_VALUE for *_, e in f)))
                        for f in found
                    ]
                ).reshape(-1, 3)
                p = m.probability(x) if m else np.full(len(text), 0.5)
                kept = [[dict(zip(("start", "end", "score", "expected"), y)) for y in f if y[3] <= E_VALUE] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(p), pa.array(kept, pa.list_(span))], ["key", "score", "passages"])

    kind = docs.schema["key"].dataType.simpleString()
    spans = "array<struct<start: long, end: long, score: double, expected: double>>"
    return docs.select("key", "text").mapInArrow(run, f"key {kind}, score double, passages {spans}")


@query("op2_toxic_segments")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    held = fold("doc_id", 5) == 0
    model = train(docs.where(~held), table(spark, sf_dir, "labels"))
    rows = score(docs.select(F.struct("doc_id", held.alias("held_out")).alias("key"), "text"), model)
    return rows.select("key.doc_id", "key.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
