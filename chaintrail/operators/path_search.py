"""Cheapest paths to one node: a label-correcting search over reversed edges.

A question about one farm needs one label per node, not a path for every pair: the search
walks the edges backwards from the farm and is done when no label improves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaintrail.operators.paths import MAX_NODES
from chaintrail.operators.skew import ROWS_PER_PART, HotKeySplit
from chaintrail.session import discard, materialise


def search_to(edges: DataFrame, target: object, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(node, cost, hops, next): the cheapest path from every node that reaches `target`, and its first step.

    A label is the least (cost, hops, next). A round extends only the labels that improved in the
    round before, so the edges of a node are read as often as its label improves; edges stay
    partitioned by their end, and a node with very many incoming edges is cut into parts. The
    labels, at most one row per node, are the only state. `target` itself has cost 0 and no step,
    also when no edge names it.
    """
    spark, kind = edges.sparkSession, edges.schema["dst"].dataType
    split = HotKeySplit(edges, "dst", rows_per_part)
    lightest = edges.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    written = materialise(split.spread(lightest, ["src"]), "reversed-steps")
    steps = written.repartition(*split.keys()).persist()
    best = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("next"), F.lit(0).alias("turn"))
    labels = materialise(spark.range(1).select(F.lit(target).cast(kind).alias("node"), best.alias("best")), "labels")
    fresh, turn = labels, 0
    while not fresh.isEmpty():
        turn += 1
        ends = split.repeat(fresh.select(F.col("node").alias("at"), "best"), "at")
        reached = ends.join(steps, split.on(steps, ends, "at")).select(
            F.col("src").alias("node"),
            F.struct(
                (F.col("best.cost") + F.col("weight")).alias("cost"),
                (F.col("best.hops") + 1).alias("hops"),
                F.col("at").alias("next"),
                F.lit(turn).alias("turn"),
            ).alias("best"),
        )
        known = labels
        labels = materialise(known.union(reached).groupBy("node").agg(F.min("best").alias("best")), "labels")
        discard(known)
        fresh = labels.where(F.col("best.turn") == turn)
    steps.unpersist()
    discard(written)
    return labels.select("node", "best.cost", "best.hops", "best.next")


def reaching(labels: DataFrame, sources: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """`sources` (with a column `id`) that reach the target, with total_cost and path_length.

    Paths of more than `max_nodes` nodes are left out, as they are not stored either.
    """
    near = labels.where(F.col("hops") < max_nodes)
    return sources.join(near, F.col("id") == F.col("node")).select(
        *sources.columns, F.col("cost").alias("total_cost"), F.col("hops").alias("path_length")
    )


def count_reaching(labels: DataFrame, sources: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    near = labels.where(F.col("hops") < max_nodes)
    return near.join(sources, F.col("id") == F.col("node"), "left_semi").agg(F.count("*").alias("reachable_slaughterhouses"))


def cheapest_reaching(labels: DataFrame, sources: DataFrame, k: int = 5, max_nodes: int = MAX_NODES) -> DataFrame:
    """The `k` sources with the cheapest path, equal costs by id."""
    return reaching(labels, sources, max_nodes).orderBy("total_cost", "id").limit(k)


def nodes_on_path(labels: DataFrame, source: object, max_nodes: int = MAX_NODES) -> DataFrame:
    """(place, node) from `source` (place 0) to the target; no row when there is no path of at most `max_nodes` nodes.

    One row is followed step by step through the labels.
    """
    at = labels.where((F.col("node") == F.lit(source)) & (F.col("hops") < max_nodes)).select("node", "next", F.lit(0).alias("place"))
    places = [materialise(at, "on-path")]
    for place in range(1, max_nodes):
        step = F.broadcast(places[-1].select(F.col("next").alias("node")))  # one row at most
        at = materialise(labels.join(step, "node").select("node", "next", F.lit(place).alias("place")), "on-path")
        places.append(at)
        if at.where(F.col("next").isNotNull()).isEmpty():
            break
    return reduce(DataFrame.union, places).select("place", "node")


def path_subgraph(on_path: DataFrame, first_edges: DataFrame, next_edges: DataFrame, source: object) -> DataFrame:
    """(kind, src, dst, total): stored edges whose ends lie on the path of `nodes_on_path`.

    The path is at most a few nodes long; both edge sets are semi-joined with it.
    """
    nodes = on_path.select("node").distinct()
    starts, ends = nodes.withColumnRenamed("node", "src"), nodes.withColumnRenamed("node", "dst")
    first = first_edges.where(F.col("src") == F.lit(source)).join(ends, "dst", "left_semi")
    between = next_edges.join(starts, "src", "left_semi").join(ends, "dst", "left_semi")
    columns = ["src", "dst", "total"]
    return first.select(F.lit("first").alias("kind"), *columns).unionByName(between.select(F.lit("next").alias("kind"), *columns))
