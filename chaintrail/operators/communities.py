"""Modularity and Louvain communities on (src, dst, weight) frames."""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import isfinite

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chaintrail.operators.community_moves import coin, levels_in_task
from chaintrail.operators.skew import ROWS_PER_PART, HotKeySplit
from chaintrail.session import discard, materialise

MAX_LEVELS = 10
MAX_ITERATIONS = 10
TOLERANCE = 1e-4
LINKS_IN_TASK = 4_000_000  # links and nodes of a level that one task may hold, at about 200 bytes each


def _labelled(edges: DataFrame, communities: DataFrame, rows_per_part: int) -> DataFrame:
    """Weight between communities: label one end, sum, label the other, sum.

    Summing after the first label leaves a hub target with one row per community, which may
    still be many; both ends are split where they are hot.
    """
    by_src, by_dst = HotKeySplit(edges, "src", rows_per_part), HotKeySplit(edges, "dst", rows_per_part)
    spread = by_src.spread(edges.select("src", "dst", "weight"), ["dst"])
    left = by_src.repeat(communities.select(F.col("id").alias("a"), F.col("community").alias("c_src")), "a")
    half = spread.join(left, by_src.on(spread, left, "a")).groupBy("c_src", "dst").agg(F.sum("weight").alias("weight"))
    half = by_dst.spread(half, ["c_src"])
    right = by_dst.repeat(communities.select(F.col("id").alias("b"), F.col("community").alias("c_dst")), "b")
    return half.join(right, by_dst.on(half, right, "b")).groupBy("c_src", "c_dst").agg(F.sum("weight").alias("weight"))


def modularity(edges: DataFrame, communities: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One row (communities, modularity); direction is ignored."""
    between = _labelled(edges, communities, rows_per_part)
    ends = between.select(
        F.explode(
            F.array(
                F.struct(F.col("c_src").alias("c"), F.col("weight").alias("w")),
                F.struct(F.col("c_dst").alias("c"), F.col("weight").alias("w")),
            )
        ).alias("e"),
        F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0).alias("inner"),
    )
    per = ends.groupBy(F.col("e.c").alias("community")).agg(F.sum("e.w").alias("total"), F.sum("inner").alias("inner"))
    # 2m = sum of total; `inner` holds each internal weight twice, once per end
    count = communities.agg(F.countDistinct("community").alias("communities"))
    q = per.agg(
        F.sum("total").cast("double").alias("m2"),
        F.sum("inner").cast("double").alias("inner"),
        F.sum(F.col("total").cast("double") * F.col("total")).alias("squares"),
    ).select((F.col("inner") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))
    return count.withColumn("modularity", q.scalar())


def community_sizes(communities: DataFrame, above: int = 20) -> DataFrame:
    """Communities of more than `above` nodes, the largest first."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("node_amount")).where(F.col("node_amount") > above)
    return sizes.orderBy(F.desc("node_amount"), "community")


def community_size_of(communities: DataFrame, node: object) -> DataFrame:
    """Number of nodes that share the community of one node."""
    own = communities.where(F.col("id") == F.lit(node)).select("community").distinct()
    return communities.join(own, "community", "left_semi").agg(F.countDistinct("id").alias("nodes"))


@dataclass
class Level:
    """One level of a run: its communities, their modularity, the turns it took, and whether it settled by itself."""

    communities: int
    modularity: float
    turns: int
    settled: bool


@dataclass
class LouvainRun:
    membership: DataFrame
    levels: list[Level]
    settled: bool

    @property
    def community_count(self) -> int:
        return self.levels[-1].communities if self.levels else self.membership.count()

    @property
    def modularity(self) -> float:
        return self.levels[-1].modularity if self.levels else 0.0


def louvain_run(
    edges: DataFrame,
    nodes: DataFrame,
    max_levels: int = MAX_LEVELS,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    rows_per_part: int = ROWS_PER_PART,
    in_task: int = 0,
) -> LouvainRun:
    """Communities (id, community) by weighted modularity, with a record of every level; direction is ignored.

    Every level moves nodes to the neighbouring community of highest gain, a changing half of the
    nodes at a time so that neighbours do not swap places, until modularity rises by less than
    `tolerance`; then communities become the nodes of the next level. A community is named after
    its smallest member. `settled` tells a run that ended because nothing improved from one that
    ran out of levels or turns.

    A turn is one job over the links, and writes one row per node. Sums over a community are added up before
    the shuffle; where a community or a hub has more than `rows_per_part` rows, joins with it are split over tasks.
    Once a level has at most `in_task` links and nodes, that level and all after it are moved inside one task, turn by turn alike.
    """
    both = edges.where(F.col("src") != F.col("dst")).select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), F.col("weight").cast("double").alias("weight")),
                F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").cast("double").alias("weight")),
            )
        ).alias("e")
    )
    links = materialise(both.select("e.*").groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "links")
    written = [links]
    loops = edges.where(F.col("src") == F.col("dst")).groupBy(F.col("src").alias("id")).agg(
        (F.sum("weight") * 2).cast("double").alias("loop")
    )
    vertices = materialise(nodes.select("id").distinct().join(loops, "id", "left").fillna(0.0, ["loop"]), "vertices")
    written.append(vertices)
    membership = vertices.select("id", F.col("id").alias("community"))
    double_m = (links.agg(F.sum("weight")).first()[0] or 0.0) + (vertices.agg(F.sum("loop")).first()[0] or 0.0)
    levels: list[Level] = []
    if not double_m:
        return LouvainRun(membership, levels, True)
    kept = vertices  # what the membership reads
    ended = False
    for level in range(max_levels):
        if in_task and isfinite(double_m) and links.count() + vertices.count() <= in_task:
            further, membership, ended = _rest_in_task(links, vertices, membership, double_m, level, max_levels, max_iterations, tolerance, rows_per_part)
            levels += further
            if further and kept is not vertices:
                discard(kept)
            break
        improved, placed, turns, q, settled = _move(links, vertices, double_m, max_iterations, tolerance, rows_per_part, level)
        if not improved:
            ended = settled
            discard(placed)
            break
        named = materialise(_named_by_smallest(placed, rows_per_part), "named")
        discard(placed)
        membership = _renamed(membership, named, rows_per_part)
        if kept is not vertices:
            discard(kept)
        kept = membership
        merged = materialise(_labelled(links, named, rows_per_part), "merged")
        inner = merged.where(F.col("c_src") == F.col("c_dst")).select(F.col("c_src").alias("id"), F.col("weight").alias("inner"))
        links = merged.where(F.col("c_src") != F.col("c_dst")).select(
            F.col("c_src").alias("src"), F.col("c_dst").alias("dst"), "weight"
        )
        vertices = materialise(
            vertices.join(named, "id")
            .groupBy(F.col("community").alias("id"))
            .agg(F.sum("loop").alias("loop"))
            .join(inner, "id", "left")
            .select("id", (F.col("loop") + F.coalesce(F.col("inner"), F.lit(0.0))).alias("loop")),
            "vertices",
        )
        discard(*written, named)
        written = [merged, vertices]
        levels.append(Level(vertices.count(), q, turns, settled))
    if levels:
        discard(*written)
    return LouvainRun(membership, levels, ended)


def louvain(edges: DataFrame, nodes: DataFrame, **options: object) -> DataFrame:
    """(id, community): the membership of `louvain_run`."""
    return louvain_run(edges, nodes, **options).membership


def _renamed(membership: DataFrame, named: DataFrame, rows_per_part: int) -> DataFrame:
    """Members of each community under the community that it, as a node, went to."""
    moved = named.select(F.col("id").alias("old"), F.col("community").alias("new"))
    by_community = HotKeySplit(membership, "community", rows_per_part)
    spread, few = by_community.spread(membership, ["id"]), by_community.repeat(moved, "old")
    joined = spread.join(few, by_community.on(spread, few, "old")).select("id", F.col("new").alias("community"))
    return materialise(joined, "membership")


def _rest_in_task(links, vertices, membership, double_m, level, max_levels, max_iterations, tolerance, rows_per_part):
    """The levels from `level` on, inside one task: (their record, the membership after them, did the last one settle)."""
    settled = levels_in_task(links, vertices, double_m, level, max_levels, 2 * max_iterations + 1, tolerance)
    told = settled.where(F.col("log").isNotNull()).select("log").first()
    log = json.loads(told["log"]) if told else {"levels": [], "ended": True}
    further = [Level(*x) for x in log["levels"]]
    if further:
        named = settled.select("id", "community")
        membership = _renamed(membership, named, rows_per_part) if level else materialise(named, "membership")
    discard(settled)
    return further, membership, log["ended"]


def _named_by_smallest(placed: DataFrame, rows_per_part: int) -> DataFrame:
    names = placed.groupBy("community").agg(F.min("id").alias("name"))
    split = HotKeySplit(placed, "community", rows_per_part)
    many, few = split.spread(placed, ["id"]), split.repeat(names.withColumnRenamed("community", "_named"), "_named")
    return many.join(few, split.on(many, few, "_named")).select("id", F.col("name").alias("community"))


def _sums(state: DataFrame) -> DataFrame:
    """(of, sum_k, count) of every community: one row each, added up before the shuffle."""
    return state.groupBy(F.col("community").alias("of")).agg(F.sum("k").alias("sum_k"), F.count("*").alias("count"))


def _move(links, vertices, double_m, max_iterations, tolerance, rows_per_part, level):
    """Local moves of one level: (did anything improve, (id, community), turns, modularity, did it settle)."""
    split = HotKeySplit(links, "dst", rows_per_part)
    by_src = split.by("src")  # links stand in both directions
    strength = links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out"))
    state = vertices.join(strength, "id", "left").select(
        "id",
        (F.col("loop") + F.coalesce(F.col("out"), F.lit(0.0))).alias("k"),
        F.col("id").alias("community"),
    )
    state = materialise(state, "state")
    written, best_written = [state], state
    # the strength of a link's start stays for the level, and so stands with the link
    begins, starts = by_src.spread(links, ["dst"]), by_src.repeat(state.select(F.col("id").alias("start"), "k"), "start")
    begun = begins.join(starts, by_src.on(begins, starts, "start")).select("src", "dst", "weight", "k")
    spread = split.spread(begun, ["src"]).repartition(*split.keys()).persist()
    loops, size = vertices.agg(F.sum("loop"), F.count("*")).first()
    loops = loops or 0.0
    best_state, best_q, first_q, idle, settled, turn = state, None, None, 0, False, 0
    for turn in range(2 * max_iterations + 1):
        sums, members = _sums(state), HotKeySplit.none("community")
        if size > rows_per_part:  # else no community has so many members
            sums = materialise(sums, "community-sums")
            members = HotKeySplit(None, "community", rows_per_part, sums.select(F.col("of").alias("community"), "count"))
        many, few = members.spread(state, ["id"]), members.repeat(sums.drop("count"), "of")
        own = many.join(few, members.on(many, few, "of")).select("id", "k", "community", "sum_k")
        # a community's strength travels with its members, so edges never join on a community
        ends = split.repeat(own.select(F.col("id").alias("end"), F.col("community").alias("c"), "sum_k"), "end")
        link = spread.join(ends, split.on(spread, ends, "end")).select("src", "c", "weight", "sum_k", "k", F.lit(False).alias("own"))
        # a node meets its links as a row of weight 0 to its own community: nothing is joined on the start of a link
        mine = own.select(F.col("id").alias("src"), F.col("community").alias("c"), F.lit(0.0).alias("weight"), "sum_k", "k", F.lit(True).alias("own"))
        to = (
            link.unionByName(mine)
            .groupBy("src", "c")
            .agg(F.sum("weight").alias("to_c"), F.max("sum_k").alias("sum_k"), F.max("k").alias("k"), F.max("own").alias("own"))
        )
        gain = F.col("to_c") - F.col("k") * F.col("sum_k") / F.lit(double_m)
        options = to.groupBy(F.col("src").alias("id")).agg(
            F.max("k").alias("k"),
            F.max(F.when(F.col("own"), F.col("c"))).alias("community"),
            F.max(F.when(F.col("own"), F.col("sum_k"))).alias("own_sum"),
            F.max(F.when(F.col("own"), F.col("to_c"))).alias("to_own"),
            F.max(F.when(~F.col("own"), F.struct(gain.alias("gain"), F.col("c").alias("c")))).alias("best"),
        )
        stay = F.col("to_own") - F.col("k") * (F.col("own_sum") - F.col("k")) / F.lit(double_m)
        goes = (F.pmod(coin(F.col("id"), level, turn), F.lit(2)) == 0) & (
            F.col("best.gain") > stay + F.lit(1e-9 * double_m)
        )
        judged = options.select(
            "id", "k", "community", "own_sum", "to_own", F.when(goes, F.col("best.c")).otherwise(F.col("community")).alias("next")
        )
        # counted while writing; the strengths of its members, times its own, add up to the square of a community's
        seen = Observation()
        judged = materialise(
            judged.observe(
                seen,
                F.sum("to_own").alias("inner"),
                F.max(F.col("next") != F.col("community")).alias("moves"),
                F.sum(F.col("k") * F.col("own_sum")).alias("squares"),
            ),
            "judged",
        )
        inner, moves, squares = (seen.get[x] for x in ("inner", "moves", "squares"))
        discard(sums)
        q = (inner + loops) / double_m - squares / (double_m * double_m)
        if first_q is None:
            first_q = q
        idle = 0 if best_q is None or q > best_q + tolerance else idle + 1
        if best_q is None or q > best_q:
            best_q, best_state, best_written = q, state, written[-1]
        discard(*[w for w in written if w is not best_written])
        written = [best_written, judged] if best_written in written else [judged]
        # each turn moves half of the nodes: two turns in a row must bring nothing
        if idle >= 2 and (q < best_q or not moves or idle >= 3):
            settled = True
            break
        state = judged.select("id", "k", F.col("next").alias("community"))
    spread.unpersist()
    placed = materialise(best_state.select("id", "community"), "placed")
    discard(*written)
    return best_q > first_q + 1e-12, placed, turn + 1, best_q, settled
