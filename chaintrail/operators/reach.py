"""Reachability over SENDS_TO."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaintrail.session import materialise


def reach(flows: DataFrame, target: object, max_hops: int = 4) -> DataFrame:
    """(id, hops): nodes that reach `target` within 1..max_hops, with the fewest hops.

    Each round is a left semi join of the edges with the newest nodes (a hub's
    edges can be split by the engine, since the newest nodes are distinct) and a
    left anti join with the nodes known. Distinct runs before the shuffle first.
    """
    edges = flows.select("src", "dst")
    newest = edges.where(F.col("dst") == F.lit(target)).select(F.col("src").alias("id")).distinct()
    found = materialise(newest.withColumn("hops", F.lit(1)), "reach")
    rounds = [found]
    for hop in range(2, max_hops + 1):
        known = rounds[0]
        for df in rounds[1:]:
            known = known.union(df)
        step = (
            edges.join(rounds[-1].select(F.col("id").alias("dst")), "dst", "left_semi")
            .select(F.col("src").alias("id"))
            .distinct()
            .join(known.select("id"), "id", "left_anti")
        )
        found = materialise(step.withColumn("hops", F.lit(hop)), "reach")
        if found.isEmpty():
            break
        rounds.append(found)
    out = rounds[0]
    for df in rounds[1:]:
        out = out.union(df)
    return out


def reach_in_city(flows: DataFrame, target: object, places: DataFrame, geocodes: DataFrame, max_hops: int = 4) -> DataFrame:
    """Reached nodes located in one of the cities of `geocodes`."""
    there = places.select(F.col("src").alias("id"), F.col("dst").alias("geocode")).join(geocodes, "geocode", "left_semi")
    return reach(flows, target, max_hops).join(there, "id", "left_semi")
