"""Operator 8 beside brute force."""

import numpy as np

from chaintrail.llm import vector_dedup as V

SCHEMA = "vec_id long, embedding array<double>, label int, rep string, shard string"


def brute(rows, limit=0.98):
    def good(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ids = {r[0] for r in rows}
    links, near = {i: 0 for i in ids}, {i: {i} for i in ids}
    for i, v, label, *_ in rows:
        for j, w, other, *_ in rows:
            if i != j and label is not None and label == other and good(v) and good(w) and len(v) == len(w):
                a, b = (np.array(x, float) / max(map(abs, x)) for x in (v, w))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= limit:
                    links[i] += 1
                    near[i].add(j)
    comp = {i: i for i in ids}
    while True:
        new = {i: min(comp[j] for j in near[i]) for i in ids}
        if new == comp:
            return {i: (links[i], comp[i], comp[i] == i) for i in ids}
        comp = new


def planted():
    rng, rows = np.random.default_rng(5), []
    for label in range(2):
        for _ in range(12):
            v = rng.normal(size=16)
            rows += [(v + rng.normal(size=16) * 0.04 * k).tolist() + [label] for k in range(5)]
        rows += [rng.normal(size=16).tolist() + [label] for _ in range(60)]
        rows += [rows[0][:-1] + [label]] * 4
    out = [(i, r[:-1], r[-1], "x", "y") for i, r in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0], [2.0, 0.0], [1e300] * 16, [1e-300] * 16]
    out += [(1000 + i, v, 0, None, None) for i, v in enumerate(odd)]
    return out + [(2000, rows[0][:-1], None, None, None), (2001, rows[0][:-1], None, None, None)]


def compared(spark, rows):
    result = V.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in result.collect()}


def test_beside_brute_force(spark):
    rows = planted()
    assert compared(spark, rows) == brute(rows)


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD_ROWS", 20)
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    rows = [r for r in planted() if r[0] < 1000]
    frame = spark.createDataFrame(rows, SCHEMA)
    result = V.near_duplicates(frame)
    got, want = {r.vec_id: r for r in result.collect()}, brute(rows)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert all(got[i].n_links <= w[0] for i, w in want.items())
    assert V.audit(frame, result) >= 0.9


def test_empty(spark):
    assert compared(spark, []) == {}


def test_pruning_keeps_a_far_way(spark):
    x = np.array([[1, 0], [0.999, 0.045], [0.998, 0.063], [0, 1.0]])
    out = V.pruned_graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert 1 in out[0]
