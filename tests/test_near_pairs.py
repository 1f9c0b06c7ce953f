"""The search for the pairs that can be nearest, beside the tree of all pairs."""

import random

import pytest

from chaintrail.operators import near_pairs as NP
from chaintrail.operators import paths as SP
from test_graph import random_edges

EDGES = "src long, dst long, weight double"


def nearest(tree, targets, **limits):
    return sorted(tuple(r) for r in SP.nearest_source(tree, targets, **limits).collect())


def supply_edges(farms=60, sources=20, seed=5):
    """Sources 1000.. with edges to farms, few weights, so that many paths cost the same."""
    rnd = random.Random(seed)
    weight = lambda: 1.0 / (rnd.choice([5, 11, 23]) + 1)
    first = [(1000 + rnd.randrange(sources), rnd.randrange(farms), weight()) for _ in range(2 * sources)]
    return first + [(rnd.randrange(farms), rnd.randrange(farms), weight()) for _ in range(4 * farms)]


@pytest.mark.parametrize(("limits", "rows_per_part"), [({}, 7), ({"min_length": 1, "max_nodes": 3}, 1_000_000)])
def test_agrees_with_all_pairs(spark, limits, rows_per_part):
    frame = spark.createDataFrame(supply_edges(), EDGES)
    sources = spark.createDataFrame([(1000 + i,) for i in [*range(20), 3, 99]] + [(None,)], "id long")
    targets = spark.createDataFrame([(t, f"f{t}") for t in [*range(60), 7, 500]] + [(None, "x")], "target long, name string")
    want = nearest(SP.shortest_path_tree(frame, sources), targets, **limits)
    assert want and nearest(SP.shortest_path_tree(frame, sources, rows_per_part, nearest_to=targets, **limits), targets, **limits) == want


def test_state_is_not_all_pairs(spark, monkeypatch):
    """Every source reaches every farm, but only pairs near their target are held."""
    written = []

    def record(df, name):
        out = materialise(df, name)
        written.append(out.count())
        return out

    materialise = NP.materialise
    monkeypatch.setattr(NP, "materialise", record)
    n = 150  # a ring of farms, each with a source of its own two steps ahead
    ring = [(i, (i + 1) % n, 0.1) for i in range(n)]
    frame = spark.createDataFrame(ring + [(1000 + i, i, 0.1) for i in range(0, n, 3)], EDGES)
    sources = spark.createDataFrame([(1000 + i,) for i in range(0, n, 3)], "id long")
    targets = spark.createDataFrame([(i,) for i in range(n)], "target long")
    rows = nearest(SP.shortest_path_tree(frame, sources, nearest_to=targets), targets)
    assert [(t, hops, source) for t, hops, _, source in rows] == [(t, t % 3 + 1, 1000 + t - t % 3) for t in range(n) if t % 3]
    assert max(written) < n * len(ring) // 3 // 5


def test_unknown_weights_take_all_pairs(spark):
    frame = spark.createDataFrame([*random_edges(n=12, m=30), (3, 4, None)], EDGES)
    sources, targets = spark.range(0, 3), spark.range(12).withColumnRenamed("id", "target")
    assert not NP.searchable(frame)
    assert nearest(SP.shortest_path_tree(frame, sources, nearest_to=targets), targets) == nearest(SP.shortest_path_tree(frame, sources), targets)
