"""The search from one node beside Dijkstra on reversed edges."""

import pytest
from pyspark.sql import functions as F

from chaintrail.operators import path_search as PS
from chaintrail.operators import paths as SP
from test_graph import dijkstra, random_edges

EDGES = "src long, dst long, weight double"


def towards(edges, target):
    return dijkstra([(b, a, w) for a, b, w in edges], target)


@pytest.mark.parametrize("rows_per_part", [1_000_000, 7])
@pytest.mark.parametrize("target", [0, 11])
def test_labels(spark, rows_per_part, target):
    edges = [(b, a, w) for a, b, w in random_edges()]  # node 0 has very many incoming edges
    frame = spark.createDataFrame(edges, EDGES)
    labels = {r["node"]: r for r in PS.search_to(frame, target, rows_per_part).collect()}
    want = towards(edges, target)
    weight = {}
    for a, b, w in edges:
        weight[a, b] = min(w, weight.get((a, b), w))
    assert set(labels) == set(want)
    for node, (cost, hops) in want.items():
        got = labels[node]
        assert got["cost"] == pytest.approx(cost, abs=1e-12) and got["hops"] == hops
        if node != target:
            step = labels[got["next"]]
            assert got["cost"] == pytest.approx(step["cost"] + weight[node, got["next"]]) and got["hops"] == step["hops"] + 1


def test_state_is_one_row_per_node(spark, monkeypatch):
    """No step holds more rows than there are nodes; the edges are written once."""
    written = []

    def record(df, name):
        out = materialise(df, name)
        written.append((name, out.count()))
        return out

    materialise = PS.materialise
    monkeypatch.setattr(PS, "materialise", record)
    edges = random_edges(n=80, m=900)
    nodes = len({x for a, b, _ in edges for x in (a, b)})
    PS.search_to(spark.createDataFrame(edges, EDGES), 5).collect()
    rounds = [n for name, n in written if name == "labels"]
    assert len(rounds) > 3 and max(rounds) <= nodes
    assert sum(name == "reversed-steps" for name, _ in written) == 1


def test_a_long_cheap_path_beats_a_short_one(spark):
    chain = [(i, i + 1, 0.01) for i in range(12)] + [(0, 12, 5.0), (0, 12, 6.0)]
    labels = PS.search_to(spark.createDataFrame(chain, EDGES), 12)
    sources = spark.range(14).withColumn("name", F.concat(F.lit("s"), "id"))
    # node 0's cheapest path has 13 nodes, so it is not listed; its short dear one does not stand in
    assert {r["id"] for r in PS.reaching(labels, sources).collect()} == set(range(3, 13))
    assert PS.count_reaching(labels, sources).first()[0] == 10
    top = PS.cheapest_reaching(labels, sources.where("id < 12"), 2).collect()
    assert [(r["id"], r["name"], r["path_length"]) for r in top] == [(11, "s11", 1), (10, "s10", 2)]
    path = PS.nodes_on_path(labels, 4).orderBy("place").collect()
    assert [r["node"] for r in path] == list(range(4, 13))
    assert PS.nodes_on_path(labels, 0).count() == 0 and PS.nodes_on_path(labels, 99).count() == 0


def test_agrees_with_all_pairs(spark):
    edges = random_edges(n=40, m=150, seed=9)
    frame = spark.createDataFrame(edges, EDGES)
    sources = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "id long")
    pairs = {r["source"]: (r["total_cost"], len(r["node_ids"]) - 1) for r in SP.shortest_paths(frame, sources, 6).where("target = 7").collect()}
    got = {r["id"]: (r["total_cost"], r["path_length"]) for r in PS.reaching(PS.search_to(frame, 7), sources, 6).collect()}
    assert set(got) == set(pairs)
    for source, (cost, length) in pairs.items():
        assert got[source] == (pytest.approx(cost, abs=1e-12), length)


def test_unknown_target_equal_costs_and_no_edges(spark):
    frame = spark.createDataFrame([(1, 3, 0.5), (2, 3, 0.5), (3, 3, 0.1)], EDGES)
    alone = PS.search_to(frame, 77).collect()
    assert [tuple(r) for r in alone] == [(77, 0.0, 0, None)]
    sources = spark.createDataFrame([(2,), (1,), (8,)], "id long")
    assert [r["id"] for r in PS.cheapest_reaching(PS.search_to(frame, 3), sources).collect()] == [1, 2]
    assert PS.search_to(spark.createDataFrame([], EDGES), 1).count() == 1


def test_subgraph(spark):
    first = spark.createDataFrame([(1, 2, 5), (1, 9, 5), (8, 2, 5)], "src long, dst long, total long")
    later = spark.createDataFrame([(2, 4, 7), (4, 2, 1), (2, 9, 7), (9, 4, 1)], "src long, dst long, total long")
    graph = SP.project(SP.weighted(first).unionByName(SP.weighted(later)), "path_weight")
    on_path = PS.nodes_on_path(PS.search_to(graph, 4), 1)
    got = PS.path_subgraph(on_path, first, later, 1).collect()
    assert sorted(map(tuple, got)) == [("first", 1, 2, 5), ("next", 2, 4, 7), ("next", 4, 2, 1)]
