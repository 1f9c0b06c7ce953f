import random

from chaintrail.operators import communities as C


def some_edges(seed: int, name=lambda x: x) -> list:
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60), rnd.choice([1.0, 2.0, 5.0])) for _ in range(150)]
    edges += [(a, (a // 12) * 12 + rnd.randrange(12), 4.0) for a in range(60) for _ in range(3)]
    edges = [(name(a), name(b), w) for a, b, w in edges]
    return edges + [(name(99), name(1), 3.0), (name(2), name(98), 3.0), (name(4), name(50), None), (None, name(3), 2.0)]


def told(run: C.LouvainRun) -> tuple:
    levels = [(level.communities, round(level.modularity, 12), level.turns, level.settled) for level in run.levels]
    return {r["id"]: r["community"] for r in run.membership.collect()}, levels, run.settled


def test_levels_in_one_task_go_as_the_distributed_ones(spark, monkeypatch):
    """Levels that fit a task took all their time in the jobs of their turns."""
    written, write = [], C.materialise

    def noted(df, name="step"):
        written.append(name)
        return write(df, name)

    monkeypatch.setattr(C, "materialise", noted)
    edges = spark.createDataFrame(some_edges(3, str), "src string, dst string, weight double")
    nodes = spark.createDataFrame([(str(x),) for x in [*range(60), 0]] + [(None,)], "id string")
    many = told(C.louvain_run(edges, nodes))
    assert written.count("judged") > 4 and len(many[1]) > 1
    written.clear()
    assert told(C.louvain_run(edges, nodes, in_task=1_000)) == many
    assert written.count("judged") == 0
    links = edges.where("src <> dst").distinct().count()
    assert told(C.louvain_run(edges, nodes, in_task=links)) == many  # the first level is too large for a task
    assert 4 < written.count("judged") < sum(turns for *_, turns, _ in many[1])


def test_one_task_tells_what_did_not_settle_or_improve(spark):
    edges = spark.createDataFrame(some_edges(4), "src long, dst long, weight double")
    nodes = spark.range(60)
    short = {"max_levels": 1, "max_iterations": 1}
    found = told(C.louvain_run(edges, nodes, in_task=1_000, **short))
    assert found == told(C.louvain_run(edges, nodes, **short)) and not found[2]
    alone = spark.createDataFrame([(1, 1, 2.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    assert told(C.louvain_run(alone, nodes, in_task=10)) == ({1: 1, 2: 2, None: None}, [], True)
