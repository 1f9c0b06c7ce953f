"""Searches inside tasks, beside the rounds over tables."""

import pytest

from chaintrail.operators import paths as SP
from test_near_pairs import EDGES, nearest, supply_edges


def graph(spark):
    edges = [*supply_edges(), (5, 6, 0.0), (6, 5, 0.0), (7, 7, 0.1), (None, 8, 0.1), (9, None, 0.1)]
    sources = spark.createDataFrame([(1000 + i,) for i in [*range(20), 3, 99]] + [(None,), (5,)], "id long")
    return spark.createDataFrame(edges, EDGES), sources


def no_rounds(*_args):
    raise AssertionError("rounds over tables, where the edges fit a task")


def test_nearest_inside_tasks(spark, monkeypatch):
    """Searches in rounds took their time in hundreds of short jobs."""
    frame, sources = graph(spark)
    targets = spark.createDataFrame([(t, f"f{t}") for t in [*range(60), 7, 500, 1099]] + [(None, "x")], "target long, name string")
    every = SP.shortest_path_tree(frame, sources)
    monkeypatch.setattr(SP, "nearest_pairs", no_rounds)
    for limits in ({}, {"min_length": 0, "max_nodes": 3}):
        tree = SP.shortest_path_tree(frame, sources, nearest_to=targets, steps_in_task=1_000, **limits)
        want = nearest(every, targets, **limits)
        assert want and nearest(tree, targets, **limits) == want
        assert not tree.exceptAll(every).count()  # a pair has its cost, steps and predecessor from the tree of all pairs


def test_paths_inside_tasks(spark, monkeypatch):
    frame, sources = graph(spark)
    listed = lambda paths: sorted(map(repr, paths.collect()))
    want = {most: listed(SP.shortest_paths(frame, sources, max_nodes=most)) for most in (10, 3)}
    monkeypatch.setattr(SP, "_trees", no_rounds)
    for most, rows in want.items():
        assert rows and listed(SP.shortest_paths(frame, sources, max_nodes=most, steps_in_task=1_000)) == rows


@pytest.mark.parametrize("last", [(3, 4, None), (3, 4, -0.01)])
def test_odd_weights_and_many_edges_go_in_rounds(spark, monkeypatch, last):
    monkeypatch.setattr(SP, "nearest_in_tasks", no_rounds)
    monkeypatch.setattr(SP, "paths_in_tasks", no_rounds)
    frame = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25), last], EDGES)
    sources, targets = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(3,)], "target long")
    assert nearest(SP.shortest_path_tree(frame, sources, nearest_to=targets, steps_in_task=1_000), targets) == [(3, 2, 0.75, 1)]
    assert len(SP.shortest_paths(frame, sources, steps_in_task=1_000).collect()) == 4
    assert len(SP.shortest_paths(frame.where("src < 3"), sources, steps_in_task=1).collect()) == 3


@pytest.mark.parametrize("weight", ["nan", "inf"])
def test_weights_without_a_sum_go_in_rounds(spark, monkeypatch, weight):
    monkeypatch.setattr(SP, "paths_in_tasks", no_rounds)
    frame = spark.createDataFrame([(1, 2, 0.5), (2, 3, float(weight))], EDGES)
    paths = SP.shortest_paths(frame, spark.createDataFrame([(1,)], "id long"), steps_in_task=1_000)
    assert sorted((r["target"], repr(r["total_cost"])) for r in paths.collect()) == [(1, "0.0"), (2, "0.5"), (3, weight)]


def test_no_edges(spark):
    sources = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    paths = SP.shortest_paths(spark.createDataFrame([], EDGES), sources, steps_in_task=1_000)
    assert sorted((r["source"] or 0, r["node_ids"]) for r in paths.collect()) == [(0, [None]), (1, [1]), (1, [1])]
