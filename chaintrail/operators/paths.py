"""Target-year edges, weighted shortest paths from every source, and lookups on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.functions.measures import path_weight
from chaintrail.operators.near_pairs import nearest_pairs, searchable
from chaintrail.operators.path_arrays import nearest_in_tasks, paths_in_tasks
from chaintrail.operators.permits import SLAUGHTERHOUSE
from chaintrail.operators.skew import ROWS_PER_PART, HotKeySplit
from chaintrail.session import bucketed, discard, materialise

MAX_NODES = 10
LAYERS = 4  # rounds of improvements that lie beside the tree before they are merged into it
PAIR = ["source", "target"]
ROWS_AT_ONCE = 200_000_000  # pairs times edges that a round of one batch of sources may try
BROADCAST_STEPS = 1_000_000  # up to so many edges go to the tree instead of the tree's pairs to them
GROUP_NODES = 2_000_000  # a task may hold the tree of one source up to this size


def target_year_edges(flows: DataFrame, year: int) -> DataFrame:
    """Slaughterhouse -> farm, for farms that sent to it in the year."""
    total = F.col(f"total_{year}")
    return flows.where((F.col("dst_label") == SLAUGHTERHOUSE) & (total > 0)).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), total.alias("total")
    )


def compatible_edges(marked: DataFrame) -> DataFrame:
    """Receiving farm -> sending farm, with the animals of the compatible groups."""
    return (
        marked.where(F.col("possible_source"))
        .groupBy(F.col("dest_id").alias("src"), F.col("origin_id").alias("dst"))
        .agg(F.sum("amount").cast("long").alias("total"))
    )


def weighted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("path_weight", path_weight(F.col("total")))


def project(edges: DataFrame, weight: str, keep: Column | None = None) -> DataFrame:
    """(src, dst, weight) of the edges an algorithm runs on."""
    chosen = edges if keep is None else edges.where(keep)
    return chosen.select("src", "dst", F.col(weight).alias("weight"))


def shortest_path_tree(
    edges: DataFrame,
    sources: DataFrame,
    rows_per_part: int = ROWS_PER_PART,
    nearest_to: DataFrame | None = None,
    min_length: int = 2,
    max_nodes: int = MAX_NODES,
    steps_in_task: int = 0,
) -> DataFrame:
    """(source, target, cost, hops, pred) of the cheapest path of every reachable pair.

    With `nearest_to` (column `target`), only pairs that `nearest_source` needs for these targets, with its
    `min_length` and `max_nodes`, are looked for. Weights that are null or negative take all pairs. With at
    most `steps_in_task` edges each task holds them all, and searches from its sources on its own.
    """
    lightest = _lightest(edges)
    if nearest_to is not None and searchable(lightest):
        if steps_in_task:
            lightest = materialise(lightest, "lightest")
            if _fits_task(lightest, steps_in_task):
                found = materialise(nearest_in_tasks(lightest, sources, max_nodes), "near-pairs")
                discard(lightest)
                return found
        return nearest_pairs(lightest, sources, nearest_to, min_length, max_nodes, rows_per_part)
    return _stack(_trees(edges, sources, rows_per_part)[0])


def _lightest(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def _fits_task(edges: DataFrame, most: int) -> bool:
    """Whether there are at most so many edges, and none whose weight has no sum to compare."""
    return edges.count() <= most and edges.where(F.isnan("weight") | (F.col("weight") == float("inf"))).isEmpty()


def _trees(edges: DataFrame, sources: DataFrame, rows_per_part: int) -> tuple[list[DataFrame], int]:
    """The tree of all pairs in tables bucketed by source, one per batch of sources, and the number of nodes with an edge to them.

    A batch has so many sources that a round of it tries about `ROWS_AT_ONCE` rows at most. What is
    held beside the finished trees, layers, shuffles and sorts, is that of one batch.
    """
    spark = edges.sparkSession
    split = HotKeySplit(edges, "src", rows_per_part)
    steps = bucketed(split.spread(_lightest(edges), ["dst"]), split.keys(), "steps")
    starts = materialise(sources.select("id").distinct(), "starts")
    width, ends, count = steps.count(), steps.select("dst").distinct().count(), starts.count()
    batches = max(1, -(-count * width // ROWS_AT_ONCE))
    at_home = width <= BROADCAST_STEPS and count >= batches * 4 * spark.sparkContext.defaultParallelism
    trees = []
    for batch in range(batches):
        part = starts.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch) if batches > 1 else starts
        with _grouped_by_source(spark) if at_home else nullcontext():
            trees.append(_tree(steps, split, part, at_home).select("source", "target", "best.cost", "best.hops", "best.pred"))
    discard(steps, starts)
    return trees, ends


@contextmanager
def _grouped_by_source(spark: SparkSession) -> Iterator[None]:
    """Tables that lie by source join on pairs where they are."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _tree(steps: DataFrame, split: HotKeySplit, sources: DataFrame, at_home: bool) -> DataFrame:
    """(source, target, best) bucketed by source: the least (cost, hops, pred) of every pair of these sources.

    All sources advance together. A round extends the pairs improved last and keeps per pair
    the least (cost, hops, pred); it ends when nothing improves, so no bound on hops can hide a
    cheaper long path. A pair carries its predecessor, not its path. Edges are bucketed by their
    start, hubs cut into parts.

    The tree stays where it is: it and the improvements of each round are tables bucketed by pair,
    and what a round tries is grouped by pair into the same buckets. A round shuffles the
    improvements to their edges and what it tries to its pairs; the tree is read in place. When
    `LAYERS` rounds lie beside it, they are merged bucket by bucket.

    `at_home`, for many sources and few edges: tables are bucketed by source, the edges go to them by
    broadcast, and a round shuffles nothing.
    """
    keys = ["source"] if at_home else PAIR
    pred_type = steps.schema["src"].dataType
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast(pred_type).alias("pred"))
    layers = [bucketed(sources.select(F.col("id").alias("source"), F.col("id").alias("target"), start.alias("best")), keys, "tree")]
    fresh, spent = layers[0], []
    while not fresh.isEmpty():
        starts = fresh.select("source", F.col("target").alias("at"), "best")
        new = F.struct((F.col("best.cost") + F.col("weight")).alias("cost"), (F.col("best.hops") + 1).alias("hops"), F.col("at").alias("pred"))
        if at_home:
            reached = starts.join(F.broadcast(steps), F.col("at") == F.col("src"))
        else:
            starts = split.repeat(starts, "at")
            reached = starts.join(steps, split.on(steps, starts, "at"))
        tried = reached.where(F.col("source") != F.col("dst")).select("source", F.col("dst").alias("target"), new.alias("new"))
        tried = tried.groupBy(*PAIR).agg(F.min("new").alias("new"))
        # the newest layer that knows a pair holds its best
        known, best = tried, F.lit(None)
        for i, layer in enumerate(layers):
            known = known.join(layer.select(*PAIR, F.col("best").alias(f"_{i}")), PAIR, "left")
            best = F.coalesce(F.col(f"_{i}"), best) if i else F.col("_0")
        better = known.where(best.isNull() | (F.col("new") < best))
        fresh = bucketed(better.select(*PAIR, F.col("new").alias("best")), keys, "fresh")
        layers.append(fresh)
        discard(*spent)
        spent = []
        if len(layers) > LAYERS:
            # the last improvements are still to be extended, and go after the next round
            merged = bucketed(_merged(layers), keys, "tree")
            discard(*layers[:-1])
            spent, layers = [fresh], [merged]
    tree = _merged(layers)
    tree = bucketed(tree if at_home else tree.repartition("source"), ["source"], "finished")
    discard(*layers, *spent)
    return tree


def _merged(layers: list[DataFrame]) -> DataFrame:
    """One row per pair of layers over each other, from the newest layer that has the pair; buckets stay apart."""
    return _stack([_without(layer, layers[i + 1 :]) for i, layer in enumerate(layers)])


def _without(layer: DataFrame, newer: list[DataFrame]) -> DataFrame:
    for other in newer:
        layer = layer.join(other.select(*PAIR), PAIR, "left_anti")
    return layer


def _stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.union(df)
    return out


def shortest_paths(
    edges: DataFrame, sources: DataFrame, max_nodes: int = MAX_NODES, rows_per_part: int = ROWS_PER_PART, steps_in_task: int = 0
) -> DataFrame:
    """(source, target, total_cost, node_ids, costs) of cheapest paths of at most max_nodes nodes.

    Only the finished trees are kept. Paths are read off them when the result is read, source by source
    where the trees lie, so that they take no room. Trees of more than `GROUP_NODES` nodes are read
    level by level instead, and those paths are written.

    With at most `steps_in_task` edges, of known weights and none negative, each task holds them all and searches
    from its sources on its own: no tree is kept, and the searches are made when the result is read.
    """
    few = materialise(_lightest(edges), "lightest") if steps_in_task else None
    if few is not None and _fits_task(few, steps_in_task) and searchable(few):
        found = paths_in_tasks(few, sources, max_nodes)
        discard(few)
        return _repeated(found, sources)
    if few is not None:
        discard(few)
    trees, nodes = _trees(edges, sources, rows_per_part)
    if nodes > GROUP_NODES:
        found = _stack([_paths_by_level(tree, max_nodes) for tree in trees])
    else:
        kind = edges.schema["src"].dataType.simpleString()
        schema = f"source {trees[0].schema['source'].dataType.simpleString()}, target {kind}, total_cost double, node_ids array<{kind}>, costs array<double>"
        paths_of = _path_reader(max_nodes)
        found = _stack([tree.groupBy("source").applyInArrow(paths_of, schema) for tree in trees])
    return _repeated(found, sources)


def _repeated(found: DataFrame, sources: DataFrame) -> DataFrame:
    """The paths of a source that is listed more than once, as often."""
    repeated = sources.groupBy(F.col("id").alias("_id")).agg(F.count("*").cast("int").alias("_times")).where("_times > 1")
    if repeated.isEmpty():
        return found
    times = F.array_repeat(F.lit(0), F.coalesce("_times", F.lit(1)))
    columns = found.columns
    return found.join(repeated, F.col("source").eqNullSafe(F.col("_id")), "left").withColumn("_time", F.explode(times)).select(*columns)


def _path_reader(max_nodes: int) -> Callable[[pa.Table], pa.Table]:
    """Paths of one source's tree, by following all predecessors together, a step at a time."""

    def paths_of(tree: pa.Table) -> pa.Table:
        tree = tree.combine_chunks()
        targets, cost = tree["target"], tree["cost"]
        up = pc.fill_null(pc.index_in(tree["pred"], value_set=targets, skip_nulls=True), -1).to_numpy()
        up = np.append(up, -1)  # the source has no predecessor, and nothing has none either
        at = np.arange(len(targets))
        places = [at]
        while len(places) < max_nodes and (at >= 0).any():
            at = up[at]
            places.append(at)
        walks = np.stack(places[::-1], axis=1)[up[at] < 0]  # those that have come to the source
        on_path = walks >= 0
        starts = pa.array(np.append(0, on_path.sum(axis=1).cumsum()), pa.int32())
        nodes, ends = pa.array(walks[on_path]), pa.array(walks[:, -1])
        columns = {
            "source": tree["source"].take(ends),
            "target": targets.take(ends),
            "total_cost": cost.take(ends),
            "node_ids": pa.ListArray.from_arrays(starts, targets.take(nodes).combine_chunks()),
            "costs": pa.ListArray.from_arrays(starts, cost.take(nodes).combine_chunks()),
        }
        return pa.table(columns)

    return paths_of


def _paths_by_level(tree: DataFrame, max_nodes: int) -> DataFrame:
    """Paths level by level: a level joins the one before with the tree once, and paths that grow too long are never built."""
    tree = tree.repartition("source", "pred").persist()
    level = tree.where(F.col("hops") == 0).select(
        "source",
        "target",
        F.col("cost").alias("total_cost"),
        F.array("target").alias("node_ids"),
        F.array("cost").alias("costs"),
    )
    levels = [materialise(level, "paths")]
    for _ in range(1, max_nodes):
        before = levels[-1].select("source", F.col("target").alias("pred"), "node_ids", "costs")
        level = materialise(
            tree.where(F.col("pred").isNotNull())
            .join(before, ["source", "pred"])
            .select(
                "source",
                "target",
                F.col("cost").alias("total_cost"),
                F.array_append("node_ids", F.col("target")).alias("node_ids"),
                F.array_append("costs", F.col("cost")).alias("costs"),
            ),
            "paths",
        )
        if level.isEmpty():
            break
        levels.append(level)
    tree.unpersist()
    return _stack(levels)


def nearest_source(tree: DataFrame, targets: DataFrame, min_length: int = 2, max_nodes: int = MAX_NODES) -> DataFrame:
    """Per row of `targets` (with a column `target`) the source with the fewest steps, kept if at least `min_length` away.

    Steps are those of the cheapest paths; paths of more than `max_nodes` nodes do not count.
    """
    near = tree.where(F.col("hops") < max_nodes).join(targets.select("target"), "target", "left_semi")
    best = near.groupBy("target").agg(F.min(F.struct(F.col("hops").alias("path_length"), F.col("cost").alias("total_cost"), "source")).alias("best"))
    far = best.where(F.col("best.path_length") >= min_length)
    return targets.join(far, "target").select(*targets.columns, "best.*")
