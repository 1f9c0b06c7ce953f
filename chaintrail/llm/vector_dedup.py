"""Operator 8: near-duplicate embeddings by a robust-pruned flat graph.

1. Rows whose unit vectors are equal are one class with a weight: copies are never compared.
2. Centres are a hashed share of the classes, one in `SHARD_ROWS` but `MAX_CENTRES` at most, less those
   close to another; every class joins the shards of its `OVERLAP` nearest centres of its label. A
   shard above `BLOCK_ROWS` is cut into blocks; nothing is capped.
3. Each block builds a graph: the nearest candidates of a vector, pruned so that no kept one is
   much nearer to another than to the vector, and some random edges. The adjacency lists a class
   got in its shards are united.
4. In each pair of blocks every class searches the other's graph, from its medoid and from the
   class's own neighbours: the nearest nodes are expanded, and all nodes in range, until no new one
   is in range. Every hit is verified by its cosine in double precision.
5. A pair met in several shards belongs to the first. Blocks return each class's number of
   links and a spanning forest of them, never all pairs.

`audit` compares the links found by every row whose id is divisible by 20 with brute force.

Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite
components, have no links and are alone; so are vectors of other lengths to each other. Rows
that repeat a vec_id count as other vectors and share a component. A null vec_id keeps null.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.llm.graph import components
from chaintrail.llm.minhash_dedup import _forest
from chaintrail.llm.registry import query, table
from chaintrail.session import materialise

SHARD_ROWS, MAX_CENTRES, OVERLAP, BLOCK_ROWS = 400, 20_000, 3, 4096
#: Centres nearer than this are one, so that a dense group lies in one shard.
CENTRE_COSINE = 0.8
NEAREST, DEGREE, RANDOM, ALPHA, HOPS = 24, 12, 4, 1.2, 4


def unit_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, vec (little-endian doubles of the unit vector; null if it can't link)."""

    def unit(x: list | None) -> bytes | None:
        if not x or any(v is None for v in x):
            return None
        v = np.array(x, dtype="<f8")
        if not np.isfinite(v).all() or not v.any():
            return None
        v /= np.abs(v).max()
        return (v / np.sqrt(v @ v) + 0.0).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = pa.array([unit(x) for x in batch.column("embedding").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), vec], ["vec_id", "label", "vec"])

    picked = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return picked.mapInArrow(run, "vec_id long, label string, vec binary")


def _matrix(vec) -> np.ndarray:
    return np.frombuffer(b"".join(vec), "<f8").reshape(len(vec), -1)


def centres(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Centres of each (label, bytes of a vector); `MAX_CENTRES` in all, but for one of each label."""
    total = classes.count()
    every = max(SHARD_ROWS, -(-2 * total // MAX_CENTRES))
    rows = classes.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("label", "rep", "vec").orderBy("label", "rep").collect()
    out: dict[tuple[str, int], list[np.ndarray]] = {}
    for r in rows:
        kept = out.setdefault((r.label, len(r.vec)), [])
        v = np.frombuffer(r.vec, "<f8")
        if not kept or (np.stack(kept) @ v).max() < CENTRE_COSINE:
            kept.append(v)
    return {k: np.stack(v) for k, v in out.items()}


def sharded(classes: DataFrame) -> DataFrame:
    """rep, weight, vec, cells (ascending, of (label, size) and centre), shard (one of the cells)."""
    spread = classes.sparkSession.sparkContext.broadcast(centres(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, vecs = batch.column("label").to_pylist(), batch.column("vec").to_pylist()
            groups: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(labels, map(len, vecs))):
                groups.setdefault(key, []).append(i)
            cells: list[list[int]] = [[0]] * len(labels)
            for key, at in groups.items():
                if key in spread.value and len(spread.value[key]) > 1:
                    near = _matrix([vecs[i] for i in at]) @ spread.value[key].T
                    best = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :OVERLAP], axis=1)
                    for i, row in zip(at, best):
                        cells[i] = row.tolist()
            columns = [batch.column(c) for c in ("label", "rep", "weight", "vec")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.list_(pa.int64()))], ["label", "rep", "weight", "vec", "cells"])

    rows = classes.select("label", "rep", "weight", "vec").mapInArrow(
        run, "label string, rep long, weight long, vec binary, cells array<long>"
    )
    rows = rows.withColumn("cell", F.explode("cells"))
    return rows.withColumn("shard", F.struct("label", F.length("vec").alias("bytes"), "cell")).drop("label")


def _nearest(s: np.ndarray, k: int) -> np.ndarray:
    part = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(s, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Out-neighbours of each row of `x`: robust-pruned nearest ones and `RANDOM` others."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, dtype=np.int64)] * n
    k, rng, out = min(NEAREST, n - 1), np.random.default_rng(8), []
    for a in range(0, n, 512):
        part = x[a : a + 512]
        s = part @ x.T
        s[np.arange(len(part)), np.arange(a, a + len(part))] = -np.inf
        near = _nearest(s, k)
        far = 1 - np.take_along_axis(s, near, axis=1)
        among = 1 - np.matmul(x[near], x[near].transpose(0, 2, 1))
        alive, kept = np.ones(near.shape, dtype=bool), np.zeros(near.shape, dtype=bool)
        for c in range(k):
            take = alive[:, c] & (kept.sum(axis=1) < DEGREE)
            kept[:, c] = take
            # what lies much nearer to the one just kept than to the vector is reached through it
            alive &= ~(take[:, None] & (ALPHA * among[:, c, :] <= far))
        others = rng.integers(0, n, (len(part), RANDOM))
        out += [np.union1d(near[i][kept[i]], others[i]) for i in range(len(part))]
    return out


def reach(q: np.ndarray, x: np.ndarray, edges: tuple[np.ndarray, np.ndarray], starts: tuple[np.ndarray, np.ndarray], limit: float) -> np.ndarray:
    """Marks (query, node) in range that the search over the graph of `x` found and verified.

    edges: (from, to), starts: (query, node).
    """
    nodes = len(x)
    joined = np.zeros((nodes, nodes), dtype=np.float32)
    joined[edges] = joined.T[edges] = 1
    found = np.zeros((len(q), nodes), dtype=bool)
    medoid = int((x @ x.mean(axis=0)).argmax())
    for a in range(0, len(q), 1024):
        cosine = q[a : a + 1024] @ x.T
        rows = np.arange(len(cosine))
        seen = np.zeros(cosine.shape, dtype=bool)
        seen[:, medoid] = True
        mine = (starts[0] >= a) & (starts[0] < a + 1024)
        seen[starts[0][mine] - a, starts[1][mine]] = True
        spent = np.zeros(cosine.shape, dtype=bool)
        hop = 0
        while True:
            todo = seen & ~spent & (cosine >= limit)
            if hop < HOPS:
                best = np.where(seen & ~spent, cosine, -np.inf).argmax(axis=1)
                todo[rows, best] |= seen[rows, best] & ~spent[rows, best]
            hop += 1
            if not todo.any():
                break
            spent |= todo
            busy = todo.any(axis=1)
            if todo.sum() < 4 * len(rows):
                for_row, node = np.nonzero(todo)
                np.logical_or.at(seen, for_row, joined[node] > 0)
            else:
                seen[busy] |= todo[busy].astype(np.float32) @ joined > 0
        found[a : a + 1024] = seen & (cosine >= limit)
    return found


def _links(members: DataFrame, limit: float) -> DataFrame:
    """(a, b, links): with b, a link between classes; without, a part of the links of class a."""

    def build(g: pd.DataFrame) -> pd.DataFrame:
        rep = g["rep"].to_numpy()
        return pd.DataFrame({"rep": rep, "out": [rep[x].tolist() for x in pruned_graph(_matrix(g["vec"].tolist()))]})

    graph = members.groupBy("shard", "block").applyInPandas(build, "rep long, out array<long>")
    united = graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out"))
    rows = members.join(united, "rep")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    queries = rows.select("*", F.col("block").alias("i"), others.alias("j"))
    # a block that meets itself is there once
    points = rows.where("blocks > 1").select("*", others.alias("i"), F.col("block").alias("j")).where("i <> j")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        shard, i, j = g["shard"].iloc[0], g["i"].iloc[0], g["j"].iloc[0]
        g = g.sort_values("rep", kind="stable").reset_index(drop=True)
        block = g["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype({"a": "Int64", "b": "Int64", "links": "Int64"})
        x, rep, weight = _matrix(g["vec"].tolist()), g["rep"].to_numpy(), g["weight"].to_numpy()
        place = np.argsort(rep[right])
        names = rep[right][place]

        def known(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lists = [np.asarray(g["out"].iloc[k], dtype=np.int64) for k in own]
            source = np.repeat(np.arange(len(own)), [len(v) for v in lists])
            target = np.concatenate(lists)
            at = np.minimum(np.searchsorted(names, target), len(names) - 1)
            ok = names[at] == target
            return source[ok], place[at[ok]]

        hits = reach(x[left], x[right], known(right), known(left), limit)
        cells = [np.asarray(c) for c in g["cells"]]
        cell = shard["cell"]
        lower = np.zeros((len(g), OVERLAP), dtype=np.int64) - 1
        for k, c in enumerate(cells):
            c = c[c < cell]
            lower[k, : len(c)] = c
        for a in range(OVERLAP):
            for b in range(OVERLAP):
                u, v = lower[left, a], lower[right, b]
                hits &= ~((u[:, None] == v[None, :]) & (u >= 0)[:, None])
        hits &= rep[left][:, None] != rep[right][None, :]
        counted = hits @ weight[right]
        some = np.flatnonzero(counted)
        forest = np.array(_forest(hits if i != j else hits | hits.T, left, right), dtype=np.int64).reshape(-1, 2) if i <= j else np.zeros((0, 2), np.int64)
        return pd.DataFrame(
            {
                "a": pd.array(np.r_[rep[left][some], rep[forest[:, 0]]], dtype="Int64"),
                "b": pd.array([*([None] * len(some)), *rep[forest[:, 1]].tolist()], dtype="Int64"),
                "links": pd.array([*counted[some].tolist(), *([0] * len(forest))], dtype="Int64"),
            }
        )

    session = members.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    dealt = queries.unionByName(points).repartition(tasks, "shard", "i", "j")
    return dealt.groupBy("shard", "i", "j").applyInPandas(search, "a long, b long, links long")


def near_duplicates(rows: DataFrame, limit: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id)."""
    base = materialise(unit_vectors(rows), "unit-vectors")
    usable = base.where("label IS NOT NULL AND vec IS NOT NULL AND vec_id IS NOT NULL")
    classes = materialise(usable.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vector-classes")
    # a repeated vec_id may stand for different vectors: classes are told apart by number, not by id
    classes = classes.withColumn("least", F.col("rep")).withColumn("rep", F.xxhash64("label", "vec"))
    members = sharded(classes)
    blocks = members.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    members = members.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    found = materialise(_links(materialise(members, "shards"), limit), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comps = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(counts, "rep", "left").join(ids, "component")
    named = named.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    alone = base.where("label IS NULL OR vec IS NULL OR vec_id IS NULL")
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = usable.join(named, ["label", "vec"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def audit(rows: DataFrame, result: DataFrame, limit: float = 0.98, block: int = 2000) -> float:
    """Share of the links of all rows whose vec_id is divisible by 20 that `result` counts."""
    base = materialise(unit_vectors(rows).where("label IS NOT NULL AND vec IS NOT NULL AND vec_id IS NOT NULL"), "audit")
    chosen = base.where("vec_id % 20 = 0")
    true, queries = 0, []

    def links_of(part: list) -> int:
        spread = base.sparkSession.sparkContext.broadcast([(r.label, bytes(r.vec)) for r in part])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups: dict = {}
            for label, vec in spread.value:
                groups.setdefault((label, len(vec)), []).append(vec)
            n = 0
            for batch in batches:
                here: dict = {}
                for label, vec in zip(batch.column("label").to_pylist(), batch.column("vec").to_pylist()):
                    here.setdefault((label, len(vec)), []).append(vec)
                n += sum(int((_matrix(groups[k]) @ _matrix(v).T >= limit).sum()) for k, v in here.items() if k in groups)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return (base.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0) - len(part)

    for r in chosen.toLocalIterator():
        queries.append(r)
        if len(queries) == block:
            true, queries = true + links_of(queries), []
    true += links_of(queries) if queries else 0
    got = result.join(chosen.select("vec_id").distinct(), "vec_id", "left_semi").agg(F.sum("n_links")).first()[0] or 0
    return got / true if true else 1.0


@query("op8_embedding_graph")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
