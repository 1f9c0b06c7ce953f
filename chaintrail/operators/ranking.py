"""Weighted PageRank and exact percentiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaintrail.operators.skew import ROWS_PER_PART, HotKeySplit
from chaintrail.session import discard, materialise

DAMPING = 0.85
ITERATIONS = 20
TOLERANCE = 1e-7
ROUNDS_PER_CUT = 5


@dataclass
class RankRun:
    """Scores (id, score), the rounds that were run, and the largest change of a score in the last one."""

    scores: DataFrame
    rounds: int
    residual: float
    converged: bool


def pagerank_run(
    edges: DataFrame,
    nodes: DataFrame,
    damping: float = DAMPING,
    iterations: int = ITERATIONS,
    tolerance: float = TOLERANCE,
    rows_per_part: int = ROWS_PER_PART,
) -> RankRun:
    """PageRank over (src, dst, weight), until no score changes by `tolerance` or for `iterations` rounds.

    score = (1 - d) + d * sum of the senders' scores by their share of weight;
    mass of nodes without outgoing edges is not handed on.

    The edges are written once and partitioned by source once. Only what a node received moves
    each round: one aggregation, summed before the shuffle. A hub source is cut into parts, so
    no task holds all of its edges. Every `ROUNDS_PER_CUT` rounds the scores are written; the
    round before enters the same aggregation then, and the written rows say how far it was off.
    """
    base = 1.0 - damping
    known_edges = materialise(edges.select("src", "dst", "weight"), "rank-edges")
    split = HotKeySplit(known_edges, "src", rows_per_part)
    sent = known_edges.groupBy(F.col("src").alias("sender")).agg(F.sum("weight").alias("sent"))
    spread = split.spread(known_edges, ["dst"])
    totals = split.repeat(sent, "sender")
    shares = (
        spread.join(totals, split.on(spread, totals, "sender"))
        .where(F.col("sent") > 0)
        .select(*split.keys(), "dst", (F.lit(damping) * F.col("weight") / F.col("sent")).alias("share"))
    )
    written = materialise(shares, "shares")
    discard(known_edges)
    shares = written.repartition(*split.keys()).persist()

    received, cut, turn, residual = None, None, 0, float("inf")
    while turn < iterations and residual >= tolerance:
        turn += 1
        if received is None:
            flow = shares.select("dst", (F.col("share") * F.lit(base)).alias("flow"))
        else:
            known = split.repeat(received, "id")
            score = F.lit(base) + F.coalesce(F.col("received"), F.lit(0.0))
            flow = shares.join(known, split.on(shares, known, "id"), "left").select("dst", (F.col("share") * score).alias("flow"))
        if turn % ROUNDS_PER_CUT and turn < iterations:
            received = flow.groupBy(F.col("dst").alias("id")).agg(F.sum("flow").alias("received"))
            continue
        flow = flow.withColumn("before", F.lit(None).cast("double"))
        if received is not None:
            flow = flow.unionByName(received.select(F.col("id").alias("dst"), F.lit(0.0).alias("flow"), F.col("received").alias("before")))
        both = flow.groupBy(F.col("dst").alias("id")).agg(F.sum("flow").alias("received"), F.max("before").alias("before"))
        both = materialise(both, "rank")
        change = F.abs(F.col("received") - F.coalesce(F.col("before"), F.lit(0.0)))
        residual = both.agg(F.max(change)).first()[0] or 0.0
        if cut is not None:
            discard(cut)
        received, cut = both.select("id", "received"), both
    shares.unpersist()
    discard(written)
    if received is None:
        return RankRun(nodes.select("id", F.lit(base).alias("score")), 0, residual, False)
    scores = nodes.select("id").join(received, "id", "left").select(
        "id", (F.lit(base) + F.coalesce(F.col("received"), F.lit(0.0))).alias("score")
    )
    return RankRun(scores, turn, residual, residual < tolerance)


def pagerank(edges: DataFrame, nodes: DataFrame, **options: object) -> DataFrame:
    """(id, score): the scores of `pagerank_run`."""
    return pagerank_run(edges, nodes, **options).scores


def l1_scale(df: DataFrame, score: str = "score") -> DataFrame:
    """Divide a score by the sum of its absolute values."""
    total = df.agg(F.sum(F.abs(F.col(score)))).scalar()
    return df.withColumn(score, F.col(score) / total)


def top_ranked(scores: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """The k highest scores with name and tax number; names break ties."""
    return (
        names.join(scores, "id").select("name", "tax_number", "score").orderBy(F.desc("score"), "name", "tax_number").limit(k)
    )


def _ordered_bits(df: DataFrame, column: str) -> DataFrame:
    """(key): the bits of each value that is not null, as a long in the order of the values; NaN is last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False) + 0.0  # one zero
            v = np.where(np.isnan(v), np.nan, v)  # one NaN
            bits = v.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))], ["key"])

    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    return values.mapInArrow(run, "key long")


def _value_of(key: int) -> float:
    bits = np.int64(key)
    return float(np.array([bits ^ np.int64(2**63 - 1) if bits < 0 else bits], dtype=np.int64).view(np.float64)[0])


DIGIT = 16


def exact_percentile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row with the exact continuous percentile of a column, null without values.

    Radix selection: the values' bits, as numbers in the order of the values, are written once;
    four passes count them by 16 bits each, from the highest on, inside the prefix that the ranks
    asked for have so far. A pass brings at most 2 x 65,536 counts to the driver, whatever the
    values, and the last one knows both ranks bit by bit.
    """
    keys = materialise(_ordered_bits(df, column), "percentile")
    total = keys.count()
    if not total:
        return df.limit(0).agg(F.max(F.col(column).cast("double")).alias(column))
    place = q * (total - 1)
    wanted = {int(place): (None, int(place)), min(int(place) + 1, total - 1): (None, min(int(place) + 1, total - 1))}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        prefixes = sorted({p for p, _ in wanted.values() if p is not None})
        digit = F.shiftright("key", shift)
        some = keys.where(F.shiftright("key", shift + DIGIT).isin(prefixes)) if prefixes else keys
        counts = sorted(map(tuple, some.groupBy(digit.alias("digit")).count().collect()))
        for rank, (prefix, left) in wanted.items():
            for value, n in counts:
                if prefix is not None and value >> DIGIT != prefix:
                    continue
                if left < n:
                    wanted[rank] = (value, left)
                    break
                left -= n
    discard(keys)
    low, high = (_value_of(wanted[r][0]) for r in (int(place), min(int(place) + 1, total - 1)))
    share = place - int(place)
    result = low if low == high or not share else low + (high - low) * share
    return df.sparkSession.range(1).select(F.lit(result).alias(column))
