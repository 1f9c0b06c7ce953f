"""Operator 1: near-duplicate documents by bottom-k sketches from one hash function.

1. Every text becomes its set of hashed word shingles; the smallest `SKETCH` hashes are kept.
   Texts with equal sets are one class from here on.
2. Inverted lists of the `INDEXED` smallest retained values. A pair at the threshold shares
   at least `shared_at_least()` of them (but for a chance of 1e-9), so each class may leave
   out that many less one, and leaves out its most frequent values: boilerplate and passages
   that many documents share.
3. In every list each class meets the list's first class. The union of both sketches
   estimates the similarity, hopeless pairs go, and the full sets decide about the rest. While
   lists leave much to compare and it helps, this is repeated with other classes in the middle:
   each round meets every class of an open list once or twice.
4. What is in one component needs no comparison. In lists with several components, the classes
   outside the largest one are swept in blocks past all others, on sketches: a block's task
   returns a spanning forest of the pairs that are possible links between components. Each
   component of these forests is swept in the same way, on full sets, for a forest of links.
   No step emits all pairs.

Nothing is capped: a list of any length is cut into blocks, and every class outside its largest
component is compared with all others.

Null, empty and blank texts have no shingles and are alone. Rows that repeat a doc_id repeat
in the result when their texts are equal; a doc_id must not stand for different texts. A row
without doc_id keeps a null id and a null component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.llm.arrow_text import ragged_take, shingle_sets, slices
from chaintrail.llm.graph import components
from chaintrail.llm.registry import query, table
from chaintrail.session import discard, materialise

SKETCH, INDEXED, MISS = 64, 64, 1e-9
#: Of one block in a sweep: classes, and shingles of their texts.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1_000_000
#: Of a block, rows that are compared with the other block at once; pairs that are added to its table at once.
STRIP_ROWS, PAIRS_AT_ONCE = 256, 1_000_000
#: Classes that one hub meets in one task.
HUB_ROWS = 2000
#: Comparisons of sketches that lists may leave before further classes are put in their middle, and the share of them
#: such a round must save to be followed by another.
LEFT_TO_SWEEP, SAVED = 200_000_000, 0.2


def _tail(size: int, similarity: float) -> int:
    """Largest s for which fewer than s of `size` union values lie in both sets with chance below MISS."""
    total, s = 0.0, 0
    while True:
        total += comb(size, s) * similarity**s * (1 - similarity) ** (size - s)
        if total > MISS:
            return s
        s += 1


def shared_at_least(threshold: float) -> int:
    return max(1, _tail(INDEXED, threshold))


def estimate_floor(threshold: float) -> float:
    """Smallest share of the union sketch that a pair at the threshold may show."""
    return _tail(SKETCH, threshold) / SKETCH


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), f1, f2 (128-bit sums over the set), sketch (smallest hashes, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), k)
                f1 = [int(s.sum(dtype=np.uint64)) for s in sets]
                f2 = [int((s * (s >> np.uint64(17) | np.uint64(1))).sum(dtype=np.uint64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array(f1, np.uint64).view(np.int64)),
                        pa.array(np.array(f2, np.uint64).view(np.int64)),
                        pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "f1", "f2", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sketch array<long>")


def _may_leave_out(threshold: float) -> Column:
    """How many of its `kept` values a class may leave out and still meet every class at the threshold in a list.

    A set smaller than `INDEXED` is known as a whole: a partner shares the threshold's part of the larger
    of both, less what the partner's sketch leaves out.
    """
    n = F.col("kept").cast("double")
    small = F.least(threshold * n, n - F.greatest(F.lit(0.0), n / threshold - INDEXED))
    few = F.greatest(F.floor(small + 1e-9) - 1, F.lit(0))
    return F.when(F.col("kept") < INDEXED, few).otherwise(shared_at_least(threshold) - 1).cast("int")


def _index(reps: DataFrame, threshold: float) -> DataFrame:
    """(value, rep, n): inverted lists of two and more classes, without each class's most frequent values."""
    values = reps.select("rep", "n", F.explode(F.slice("sketch", 1, INDEXED)).alias("value"))
    lists = values.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    common = values.join(lists, "value")
    ranked = common.groupBy("rep").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("length", "value")), asc=False).alias("common")
    ).withColumn("kept", F.least("n", F.lit(INDEXED)))
    left = F.expr("slice(common, skip + 1, greatest(size(common) - skip, 0))")
    return ranked.withColumn("skip", _may_leave_out(threshold)).select("rep", "n", F.explode(left.getField("value")).alias("value"))


def _overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets in `a` with all in `b`.

    Values that few sets hold add their pairs one by one, frequent ones through a matrix product.
    """
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    counts = np.zeros((len(a), len(b)), dtype=np.float32)
    places = []
    for sets in (a, b):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        ok = shared[at] == flat if len(shared) else np.zeros(len(flat), dtype=bool)
        order = np.argsort(at[ok], kind="stable")
        places.append((at[ok][order], row[ok][order], np.bincount(at[ok], minlength=len(shared))))
    (at_a, row_a, n_a), (at_b, row_b, n_b) = places
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    few = np.flatnonzero(n_a * n_b <= 256)
    for part in np.array_split(few, 1 + int((n_a[few] * n_b[few]).sum()) // PAIRS_AT_ONCE):
        # every row of `a` that holds a value, repeated for every row of `b` that holds it
        left = ragged_take(row_a, first_a[part], n_a[part])
        width = np.repeat(n_b[part], n_a[part])
        right = ragged_take(row_b, np.repeat(first_b[part], n_a[part]), width)
        np.add.at(counts, (np.repeat(left, width), right), 1)
    many = np.flatnonzero(n_a * n_b > 256)
    column = np.full(len(shared), -1)
    for start in range(0, len(many), 2048):
        part = many[start : start + 2048]
        column[part] = np.arange(len(part))
        one = []
        for at, row, sets in ((at_a, row_a, a), (at_b, row_b, b)):
            m = np.zeros((len(sets), len(part)), dtype=np.float32)
            here = column[at] >= 0
            m[row[here], column[at[here]]] = 1
            one.append(m)
        for rows in _strips(len(a)):
            counts[rows] += one[0][rows] @ one[1].T
        column[part] = -1
    return counts


def _strips(rows: int) -> Iterator[slice]:
    return (slice(at, at + STRIP_ROWS) for at in range(0, rows, STRIP_ROWS))


def _marked(both: np.ndarray, x: np.ndarray, y: np.ndarray, test) -> np.ndarray:
    """`test(both, x, y)` for a table of pairs, a strip of its rows at a time: what it makes on the way would fill the worker."""
    ok = np.zeros(both.shape, dtype=bool)
    for rows in _strips(len(x)):
        ok[rows] = test(both[rows], x[rows], y)
    return ok


def _forest(ok: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (x[i], y[j]) with ok[i, j]; x and y are row numbers."""
    rows = [ok, np.ascontiguousarray(ok.T)]
    sides, todo = [x, y], [ok.any(axis=1), ok.any(axis=0)]
    same = len(x) == len(y) and bool((x == y).all())
    edges = []
    for start in np.flatnonzero(todo[0]):
        if not todo[0][start]:
            continue
        todo[0][start] = False
        if same:
            todo[1][start] = False
        stack = [(0, int(start))]
        while stack:
            side, at = stack.pop()
            new = np.flatnonzero(rows[side][at] & todo[1 - side])
            todo[1 - side][new] = False
            if same:
                todo[side][new] = False
            edges += [(int(sides[side][at]), int(sides[1 - side][j])) for j in new]
            stack += [(1 - side, int(j)) for j in new]
    return edges


def _fitting(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (hub, rep) of pairs (hub, hub_n, rep, n) whose sizes allow the similarity."""
    fits = den * F.least("n", "hub_n") >= num * F.greatest("n", "hub_n")
    return pairs.where((F.col("rep") != F.col("hub")) & fits).select("hub", "rep").distinct()


def _first_hubs(index: DataFrame) -> DataFrame:
    """(hub, hub_n, rep, n): every class of a list with the list's first class."""
    hubs = index.groupBy("value").agg(F.min("rep").alias("hub"), F.min_by("n", "rep").alias("hub_n"), F.count("*").alias("c"))
    return index.join(hubs.where("c > 1").drop("c"), "value")


def _next_hubs(members: DataFrame, turn: int) -> DataFrame:
    """(hub, hub_n, rep, n): the classes outside their list's largest component with one class inside and one outside it."""
    order, one = F.xxhash64("rep", F.lit(turn)), F.struct(F.col("rep").alias("hub"), F.col("n").alias("hub_n"))
    hubs = members.groupBy("value").agg(
        F.min_by(one, F.when(~F.col("out"), order)).alias("inside"), F.min_by(one, F.when(F.col("out"), order)).alias("outside")
    )
    met = members.where("out").join(hubs, "value")
    return met.select(F.explode(F.array("inside", "outside")).alias("middle"), "rep", "n").select("middle.*", "rep", "n").where("hub IS NOT NULL")


def _against_hub(pairs: DataFrame, payload: DataFrame, kind: str, check) -> DataFrame:
    """Streams each hub's members past it, `HUB_ROWS` at a time: one shuffle, one hub in memory.

    `payload` has rep and one column `body`; `check(hub_body, bodies)` marks members that stay.
    """
    numbered = pairs.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("parts")
    members = numbered.join(payload, "rep").select("hub", "part", F.lit(1).alias("role"), "rep", "body")
    heads = (
        numbered.select("hub", "part").distinct().join(payload.withColumnRenamed("rep", "hub"), "hub")
        .select("hub", "part", F.lit(0).alias("role"), F.col("hub").alias("rep"), "body")
    )
    rows = members.unionByName(heads).repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, hub_key = None, None
        for batch in batches:
            for part in slices(batch, "body") if kind == "text" else [batch]:
                hub, cut, role = (part.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "part", "role"))
                starts = np.flatnonzero(np.r_[True, (np.diff(hub) != 0) | (np.diff(cut) != 0)])
                keep = np.zeros(part.num_rows, dtype=bool)
                for a, b in zip(starts, [*starts[1:], part.num_rows]):
                    bodies = part.column("body").slice(a, b - a)
                    if role[a] == 0:
                        head, hub_key, skip = bodies.slice(0, 1), (hub[a], cut[a]), 1
                    else:
                        skip = 0
                    assert hub_key == (hub[a], cut[a])
                    if b - a > skip:
                        keep[a + skip : b] = check(head, bodies.slice(skip))
                yield part.select(["hub", "rep"]).filter(pa.array(keep))

    return rows.mapInArrow(run, "hub long, rep long")


def _with_parts(pairs: DataFrame) -> DataFrame:
    """Cut the members of large hubs into parts of about HUB_ROWS."""
    counts = pairs.groupBy("hub").count().select("hub", F.ceil(F.col("count") / HUB_ROWS).alias("parts"))
    return pairs.join(counts, "hub")


def _with_outsiders(members: DataFrame) -> DataFrame:
    """(value, rep, comp, n, out): `out` marks the classes outside the largest component of their list."""
    sizes = members.groupBy("value", "comp").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("value").agg(F.max(F.struct(F.col("c"), F.col("comp"))).alias("largest"))
    return members.join(largest, "value").select("value", "rep", "comp", "n", (F.col("comp") != F.col("largest.comp")).alias("out"))


def _sweep(members: DataFrame, payload: DataFrame, unit: Column, limit: int, run, schema: str) -> DataFrame:
    """Compare the classes outside the largest component of each list with each other and with those in it, in blocks.

    `unit` is what a block may hold `limit` of in sum. A class in the largest component is copied once for each
    block of outsiders, an outsider once for each block of its list.
    """
    members = _with_outsiders(members)
    blocks = lambda own: F.greatest(
        F.ceil(F.sum(F.when(own, unit)) / limit), F.ceil(F.count(F.when(own, 1)) / BLOCK_ROWS), F.lit(0)
    ).cast("int")
    out = F.col("out")
    size = members.groupBy("value").agg(blocks(out).alias("outer"), blocks(~out).alias("inner"))
    own = F.pmod(F.xxhash64("rep"), F.when(out, F.col("outer")).otherwise(F.col("inner"))).cast("int")
    dealt = members.join(size.where("outer > 0"), "value").withColumn("block", own)
    upto = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: i - 1)
    nothing = F.array().cast("array<int>")
    # outsiders with outsiders: blocks i <= j; outsiders of block i with insiders of block j, which is numbered from -1 down
    among = F.transform(upto(F.col("outer")), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    across = F.transform(
        F.when(F.col("inner") > 0, upto(F.col("inner"))).otherwise(nothing), lambda o: F.struct(F.col("block").alias("i"), (-o - 1).alias("j"))
    )
    inside = F.transform(upto(F.col("outer")), lambda o: F.struct(o.alias("i"), (-F.col("block") - 1).alias("j")))
    place = F.explode(F.when(out, F.concat(among, across)).otherwise(inside)).alias("place")
    dealt = dealt.select("value", "rep", "comp", "n", "out", "block", place).select("value", "rep", "comp", "n", "out", "block", "place.i", "place.j")
    # few bytes, much work: a fixed number of tasks, which adaptive execution doesn't merge
    session = members.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    dealt = dealt.join(payload, "rep").repartition(tasks, "value", "i", "j")
    return dealt.groupBy("value", "i", "j").applyInPandas(run, schema)


def _halves(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second block (the same rows when a block meets itself)."""
    block, out = g["block"].to_numpy(), g["out"].to_numpy(dtype=bool)
    i, j = g["i"].iloc[0], g["j"].iloc[0]
    return np.flatnonzero(out & (block == i)), np.flatnonzero(~out) if j < 0 else np.flatnonzero(block == j)


def _residual(index: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of lists whose classes are in several components: (value, rep, comp, n).

    The first class of a list has met all others, so lists of two are done.
    """
    rows = index.join(comps, F.col("rep") == F.col("node"), "left")
    rows = rows.select("value", "rep", F.coalesce("component", "rep").alias("comp"), "n")
    open_lists = rows.groupBy("value").agg(F.count("*").alias("c"), F.min("comp").alias("a"), F.max("comp").alias("b"))
    return rows.join(open_lists.where("c > 2 AND a <> b").select("value"), "value").select("value", "rep", "comp", "n")


def links(docs: DataFrame, reps: DataFrame, k: int, num: int, den: int, steps: list[DataFrame]) -> DataFrame:
    """(a, b): verified links between classes that connect all that is connected by links.

    Tables written on the way are added to `steps`; they can go once the result has been read.
    """
    threshold, floor = num / den, estimate_floor(num / den)

    def keep(df: DataFrame, name: str) -> DataFrame:
        steps.append(materialise(df, name))
        return steps[-1]

    def drop(*read: DataFrame) -> None:
        """What has been read goes at once: the texts would lie beside all that follows."""
        discard(*read)
        steps[:] = [step for step in steps if all(step is not other for other in read)]

    index = keep(_index(reps, threshold), "lists")
    sketch = reps.select("rep", F.col("sketch").alias("body"))

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        # written first, so that its measured size decides how the texts meet it
        ids = materialise(wanted.select(F.col("rep").alias("doc_id")).distinct(), f"{name}-ids")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
        texts = keep(texts.groupBy(F.col("doc_id").alias("rep")).agg(F.first("text").alias("body")), name)
        discard(ids)
        return texts

    def likely(head: pa.Array, bodies: pa.Array) -> list[bool]:
        one = np.asarray(head[0].values)
        out = []
        for body in bodies:
            two = np.asarray(body.values)
            union = np.union1d(one, two)[:SKETCH] if min(len(one), len(two)) == SKETCH else np.union1d(one, two)
            both = np.intersect1d(one, two, assume_unique=True)
            both = np.intersect1d(both, union, assume_unique=True)
            # a set smaller than the sketch bounds the union sketch from below only
            out.append(len(both) >= floor * min(len(union), SKETCH) - 1e-9)
        return out

    def exact(head: pa.Array, bodies: pa.Array) -> list[bool]:
        one = shingle_sets(head, k)[0]
        out = []
        for two in shingle_sets(bodies, k):
            both = len(np.intersect1d(one, two, assume_unique=True))
            out.append(den * both >= num * (len(one) + len(two) - both))
        return out

    def met(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs that are links: by their sketches first, then by their texts."""
        done = len(steps)
        pairs = keep(_fitting(pairs, num, den), f"{name}-pairs")
        hopeful = keep(_against_hub(_with_parts(pairs), sketch, "sketch", likely), f"{name}-hopeful")
        ends = hopeful.select("rep").unionByName(hopeful.select(F.col("hub").alias("rep")))
        linked = materialise(_against_hub(_with_parts(hopeful), texts_of(ends, f"{name}-texts"), "text", exact), f"{name}-links")
        drop(*steps[done:])
        steps.append(linked)
        return linked

    stars = met(_first_hubs(index), "star")
    comps = keep(components(stars), "components")
    open_lists = keep(_residual(index, comps), "open-lists")
    before, turn = None, 0
    while True:
        marked = _with_outsiders(open_lists)
        per = marked.groupBy("value").agg(F.count("*").alias("c"), F.count(F.when(F.col("out"), 1)).alias("o"))
        work = per.agg(F.sum(F.col("c").cast("double") * F.col("o"))).first()[0] or 0.0
        if work <= LEFT_TO_SWEEP or (before is not None and work > (1 - SAVED) * before):
            break
        before, turn = work, turn + 1
        stars = stars.unionByName(met(_next_hubs(marked, turn), f"star-{turn}"))
        spent = comps, open_lists
        comps = keep(components(stars), "components")
        open_lists = keep(_residual(index, comps), "open-lists")
        drop(*spent)
    drop(index, comps)

    def edges_of(g: pd.DataFrame, ok: np.ndarray, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        pairs = np.array(_forest(ok, x, y), dtype=np.int64).reshape(-1, 2)
        rep = g["rep"].to_numpy()
        return pd.DataFrame({"hub": rep[pairs[:, 0]], "rep": rep[pairs[:, 1]]})

    def possible(g: pd.DataFrame) -> pd.DataFrame:
        x, y = _halves(g)
        sets = [np.asarray(s).view(np.uint64)[:SKETCH] for s in g["body"]]
        n, comp = g["n"].to_numpy(), g["comp"].to_numpy()
        both = _overlap([sets[i] for i in x], [sets[i] for i in y])

        def plausible(both: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            small, large = np.minimum.outer(n[x], n[y]), np.maximum.outer(n[x], n[y])
            # at least `floor` of the union sketch lies in both, and so in both sketches
            need = np.ceil(floor * np.minimum(large, SKETCH) - 1e-9)
            return (both >= need) & (den * small >= num * large) & (comp[x][:, None] != comp[y][None, :])

        return edges_of(g, _marked(both, x, y, plausible), x, y)

    def verified(g: pd.DataFrame) -> pd.DataFrame:
        x, y = _halves(g)
        sets = shingle_sets(pa.array(g["body"], pa.string()), k)
        comp = g["comp"].to_numpy()
        n = np.array([len(s) for s in sets], dtype=np.float64)
        both = _overlap([sets[i] for i in x], [sets[i] for i in y])

        def linked(both: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            both = both.astype(np.float64)
            union = n[x][:, None] + n[y][None, :] - both
            return (den * both >= num * union) & (comp[x][:, None] != comp[y][None, :])

        return edges_of(g, _marked(both, x, y, linked), x, y)

    schema = "hub long, rep long"
    plausible = _sweep(open_lists, sketch, F.lit(1), BLOCK_ROWS, possible, schema)
    # a pair is plausible only within one component of the plausible pairs: a class is swept once
    groups = components(keep(plausible, "plausible")).select(F.col("component").alias("value"), F.col("node").alias("rep"))
    members = keep(groups.join(open_lists.select("rep", "comp", "n").distinct(), "rep"), "groups")
    more = _sweep(members, texts_of(members, "group-texts"), F.col("n"), BLOCK_SHINGLES, verified, schema)
    return stars.unionByName(more)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked at num/den similarity of k-word shingle sets.

    component_id is the smallest doc_id reachable over links; kept marks that document.
    """
    base = materialise(sketches(docs, k), "sketches")
    shingled = base.where("n > 0 AND doc_id IS NOT NULL")
    classes = shingled.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    reps = classes.select("rep").join(shingled.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n", "sketch"), "rep")
    reps = materialise(reps, "classes")
    # the sketches are in the classes now
    sketched, base = base, materialise(base.drop("sketch"), "documents")
    discard(sketched)
    shingled = base.where("n > 0 AND doc_id IS NOT NULL")
    classes = shingled.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    steps: list[DataFrame] = []
    comps = materialise(components(links(docs, reps, k, num, den, steps)), "named")
    discard(*steps, reps)
    named = classes.join(comps, F.col("rep") == F.col("node"), "left")
    named = named.select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    own = base.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    rows = shingled.join(named, ["n", "f1", "f2"]).select("doc_id", "n", "component_id").unionByName(own)
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


@query("op1_minhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
