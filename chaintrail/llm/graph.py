"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaintrail.session import discard, materialise


def _minima(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each `u`, itself included; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    """Count and sum of hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (two long columns): the smallest node reachable.

    Alternates large and small stars until the links form stars around the smallest nodes; links that
    are such stars from the beginning take one round, no links none.
    A node with very many links is the hot side of a join whose other side has one row per
    node, which adaptive execution splits. Each round is written to the shared folder.
    """
    a, b = links.columns[:2]
    low, high = F.least(a, b), F.greatest(a, b)
    edges = materialise(links.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large-star")
        least = _minima(large)
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        state = _state(small)
        discard(edges, large)
        edges = small
        if state == before:
            break
        before = state
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
