"""Graph operators against brute force on small graphs, with and without hot keys."""

import heapq
import itertools
import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from chaintrail.operators import communities as C
from chaintrail.operators import paths as SP
from chaintrail.operators import permits as P
from chaintrail.operators import suppliers as S
from chaintrail.operators.groups import animal_groups, could_come_from, mark_compatible
from chaintrail.operators.ranking import exact_percentile, l1_scale, pagerank, pagerank_run
from chaintrail.operators.reach import reach
from chaintrail.sources.permits_json import PERMIT_SCHEMA

GROUP_SCHEMA = (
    "id string, origin_id long, dest_id long, dest_label string, amount int, sex string, lower_age int, upper_age int, "
    "transport_date date, transport_year int"
)


def whole_months(a, b):
    m = (b.year - a.year) * 12 + b.month - a.month
    return m - 1 if m > 0 and b.day < a.day else m


def random_groups(n=220, farms=6, hot=True):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        low = rnd.choice([0, 13, 25, 36, None, 30])
        high = None if low is None else (42 if low == 36 else rnd.choice([low + 12, low + 11, low - 5]))
        day = date(2017, 1, 1) + timedelta(days=rnd.randrange(1400))
        farm = lambda: 0 if hot and rnd.random() < 0.4 else rnd.randrange(farms)
        label = "Slaughterhouse" if rnd.random() < 0.2 else "Farm"
        rows.append((f"g{i}", farm(), farm(), label, rnd.randrange(1, 50), rnd.choice(["F", "M", None]), low, high, day, day.year))
    return rows


def brute_pairs(rows):
    out = set()
    for a, b in itertools.product(rows, rows):
        if a[0] == b[0] or b[3] != "Farm" or a[1] != b[2] or a[5] is None or a[5] != b[5] or a[8] < b[8]:
            continue
        if None in (a[6], a[7], b[6], b[7]):
            continue
        m = whole_months(b[8], a[8])
        if b[6] + m <= a[7] and b[7] + m >= a[6]:
            out.add((a[0], b[0], min(a[4], b[4]), min(a[7], b[7] + m) - max(a[6], b[6] + m) + 1))
    return out


@pytest.mark.parametrize("rows_per_cell", [20_000, 10, 3])
def test_could_come_from_with_and_without_hot_farms(spark, rows_per_cell):
    rows = random_groups()
    groups = spark.createDataFrame(rows, GROUP_SCHEMA)
    got = could_come_from(groups, groups, rows_per_cell).select("ag1", "ag2", "possible_animals", "month_intersection").collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute_pairs(rows)
    assert len(got) > 100


def test_could_come_from_plan_is_an_equi_join(spark):
    groups = spark.createDataFrame(random_groups(), GROUP_SCHEMA)
    plan = could_come_from(groups, groups)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_supplier_degrees(spark):
    rows = random_groups(160)
    rows = [(*r[:2], 99 if r[3] == "Slaughterhouse" else r[2], *r[3:]) for r in rows]
    by_id = {r[0]: r for r in rows}
    pairs = {}
    for ag1, ag2, possible, _ in brute_pairs(rows):
        pairs.setdefault(ag1, []).append((ag2, possible))
    want = {}
    for r in rows:
        if r[2] != 99 or r[9] not in (2018, 2019):
            continue
        want[(r[1], r[9], "first_degree")] = want.get((r[1], r[9], "first_degree"), 0) + r[4]
        second, third = {}, {}
        for ag2, p in pairs.get(r[0], []):
            farm = by_id[ag2][1]
            second[farm] = max(second.get(farm, 0), p)
            for ag3, p2 in pairs.get(ag2, []):
                one, two = third.get(by_id[ag3][1], (0, 0))
                third[by_id[ag3][1]] = (max(one, p), max(two, p2))
        for farm, v in second.items():
            want[(farm, r[9], "second_degree")] = want.get((farm, r[9], "second_degree"), 0) + v
        for farm, v in third.items():
            want[(farm, r[9], "third_degree")] = want.get((farm, r[9], "third_degree"), 0) + min(v)
    degrees = S.supplier_degrees(spark.createDataFrame(rows, GROUP_SCHEMA), 99, [2018, 2019])
    got = {(r["farm_id"], r["year"], r["degree"]): r["animals"] for r in degrees.collect()}
    assert got == want and any(k[2] == "third_degree" for k in want)
    for name in S.DEGREES:
        alone = S.supplier_degrees(spark.createDataFrame(rows, GROUP_SCHEMA), 99, [2018, 2019], [name]).collect()
        assert {(r["farm_id"], r["year"], r["degree"]): r["animals"] for r in alone} == {k: v for k, v in want.items() if k[2] == name}

    farms = spark.range(6).select(F.col("id"), F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("string").alias("tax_number"))
    shed = S.supply_shed(degrees, farms, [2019, 2018]).collect()
    for row in shed:
        farm = int(row["Tax_number"])
        assert row["first_degree_2019"] == want.get((farm, 2019, "first_degree"), 0)
        assert row["first_degree_2018"] == want.get((farm, 2018, "first_degree"))
        assert row["third_degree_2018"] == want.get((farm, 2018, "third_degree"))
    firsts = [r["first_degree_2019"] for r in shed]
    assert firsts == sorted(firsts, reverse=True)


def test_later_moves_count_as_compatible(spark):
    rows = [
        ("a", 1, 2, "Farm", 1, "F", 36, 42, date(2020, 5, 1), 2020),  # after the year
        ("b", 1, 2, "Farm", 1, "F", 36, 42, date(2018, 1, 1), 2018),
        ("c", 1, 2, "Farm", 1, "F", 36, 42, date(2017, 1, 1), 2017),  # too old
        ("d", 1, 2, "Slaughterhouse", 1, "F", 0, 12, date(2018, 1, 1), 2018),
        ("e", 1, 2, "Farm", 1, "F", None, None, date(2017, 1, 1), 2017),
    ]
    got = {r["id"]: r["possible_source"] for r in mark_compatible(spark.createDataFrame(rows, GROUP_SCHEMA), 2018).collect()}
    assert got == {"a": True, "b": True, "c": False, "e": False}


def raw(spark, *rows):
    base = {
        "ID": "1", "TRANSPORT_DATE": "2018-05-01", "TRANSPORT_YEAR": 2018, "SLAUGHTER_GTA": False, "ANIMALS": [],
        "ORIGIN_TAX_NUMBER": "1", "ORIGIN_NAME": "A", "DESTINATION_TAX_NUMBER": "2", "DESTINATION_NAME": "B",
        "ORIGIN_GEOCODE": "10", "ORIGIN_CITY": "X", "ORIGIN_STATE": "PA", "DESTINATION_GEOCODE": "11", "DESTINATION_CITY": "Y",
        "DESTINATION_STATE": "PA", "SPECIES": "BOVINO",
    }
    names = [n for n in spark.createDataFrame([], PERMIT_SCHEMA).columns]
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], PERMIT_SCHEMA)


def test_permit_traps(spark):
    records = raw(
        spark,
        {"ID": "1", "ANIMALS": [("BOVINO,FEMEA,0 A 12", 5), ("BOVINO,MACHO,13 A 24", None)]},
        {"ID": "2", "ANIMALS": [("BOVINO,FEMEA,0 A 12", 7)], "SLAUGHTER_GTA": True},
        {"ID": "3", "ANIMALS": [("BOVINO,FEMEA,0 A 12", 9)], "SLAUGHTER_GTA": None},
        {"ID": "4", "ANIMALS": [("BOVINO,FEMEA,0 A 12", 2)], "DESTINATION_TAX_NUMBER": None, "DESTINATION_NAME": None},
        {"ID": "5", "ORIGIN_CITY": "LATER", "ORIGIN_TAX_NUMBER": None, "ORIGIN_NAME": None},
    )
    permits, animals = P.normalise_permits(records), P.permit_animals(records)
    totals = {r["gta_id"]: r["total_animals"] for r in P.permit_totals(permits, animals).collect()}
    assert totals == {"1": 5, "2": 7, "3": 9, "4": 2, "5": 0}
    assert {r["gta_id"]: r["total_animals"] for r in P.array_total(records).collect()} == totals
    flows = {(r["src"], r["dst"]): r for r in P.sends_to(P.permit_totals(permits, animals), [2018]).collect()}
    a, b, nobody = "Farm:1:1:A", "Farm:1:2:B", "Farm:0::"
    # a slaughterhouse with the tax number and name of a farm is another node
    assert set(flows) == {(a, b), (a, "Slaughterhouse:1:2:B"), (a, nobody), (nobody, b)}
    # an unknown destination tax number keeps the total but not the year
    assert (flows[(a, nobody)]["total_sent"], flows[(a, nobody)]["total_2018"]) == (2, 0)
    to_farms, to_slaughter = P.split_destinations(permits)
    assert (to_farms.count(), to_slaughter.count()) == (3, 1)
    assert animal_groups(permits, animals).count() == 4  # the permit of unknown kind has no destination
    cities = {r["geocode"]: r["name"] for r in P.city_nodes(permits, F.col("gta_id").cast("long")).collect()}
    assert cities == {"10": "X", "11": "Y"}


def random_edges(n=60, m=240, seed=3):
    rnd = random.Random(seed)
    edges = {}
    for _ in range(m):
        a = 0 if rnd.random() < 0.33 else rnd.randrange(n)
        b = rnd.randrange(n)
        edges[(a, b)] = 1.0 / (rnd.randrange(1, 40) + 1)
    return [(a, b, w) for (a, b), w in edges.items()]


def dijkstra(edges, source):
    out = {}
    for a, b, w in edges:
        if a != b:
            out.setdefault(a, []).append((b, w))
    best, heap = {source: (0.0, 0)}, [(0.0, 0, source)]
    while heap:
        cost, hops, node = heapq.heappop(heap)
        if (cost, hops) > best[node]:
            continue
        for b, w in out.get(node, []):
            new = (cost + w, hops + 1)
            if b not in best or new < best[b]:
                best[b] = new
                heapq.heappush(heap, (*new, b))
    return best


@pytest.mark.parametrize("rows_per_part", [1_000_000, 7])
@pytest.mark.parametrize("layers", [1, 4, 99])
def test_shortest_paths(spark, monkeypatch, rows_per_part, layers):
    monkeypatch.setattr(SP, "LAYERS", layers)  # 1: each round is merged; 99: all improvements stay beside the tree
    edges = random_edges()
    weight = {(a, b): w for a, b, w in edges}
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    paths = SP.shortest_paths(frame, spark.createDataFrame([(0,), (5,), (999,)], "id long"), 6, rows_per_part).collect()
    got = {(p["source"], p["target"]): p for p in paths}
    assert len(got) == len(paths)
    want = {(s, t): v for s in (0, 5, 999) for t, v in dijkstra(edges, s).items() if v[1] <= 5}
    assert set(got) == set(want)
    for key, p in got.items():
        assert p["total_cost"] == pytest.approx(want[key][0], abs=1e-12) and len(p["node_ids"]) == want[key][1] + 1
        cost = 0.0
        for (a, b), step in zip(itertools.pairwise(p["node_ids"]), p["costs"][1:], strict=True):
            cost += weight[(a, b)]
            assert step == pytest.approx(cost)


@pytest.mark.parametrize("at_once, steps, nodes", [(200, 1_000_000, 2_000_000), (1_000_000, 1_000_000, 2_000_000), (200, 0, 5)])
def test_shortest_paths_in_batches(spark, monkeypatch, at_once, steps, nodes):
    """Only finished trees stay: what else was written is gone, and where edges go to the tree no round shuffles its rows."""
    written, plans = [], []

    def record(df, *args):
        plans.append((args[-1], df._jdf.queryExecution().executedPlan().toString()))
        out = bucketed(df, *args)
        written.append((args[-1], out._scratch_path))
        return out

    bucketed = SP.bucketed
    monkeypatch.setattr(SP, "bucketed", record)
    monkeypatch.setattr(SP, "ROWS_AT_ONCE", at_once)
    monkeypatch.setattr(SP, "BROADCAST_STEPS", steps)
    monkeypatch.setattr(SP, "GROUP_NODES", nodes)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    conf = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    edges = random_edges(n=12, m=30)
    ids = [*range(0, 40, 2), 4]  # one comes twice, some have no edge
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    paths = SP.shortest_paths(frame, spark.createDataFrame([(i,) for i in ids], "id long"), 4)
    batches = sum(name == "finished" for name, _ in written)
    assert (batches > 1) == (at_once == 200)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == conf
    assert all(os.path.exists(path) == (name == "finished") for name, path in written)
    if steps and at_once > 200:
        assert all("Exchange hashpartitioning" not in plan for name, plan in plans if name in ("fresh", "finished"))
    got = sorted((p["source"], p["target"], round(p["total_cost"], 9), len(p["node_ids"])) for p in paths.collect())
    want = [(s, t, round(c, 9), h + 1) for s in ids for t, (c, h) in dijkstra(edges, s).items() if h <= 3]
    assert got == sorted(want)
    for p in paths.collect():
        assert p["node_ids"][0] == p["source"] and p["node_ids"][-1] == p["target"] and p["costs"][0] == 0.0 and p["costs"][-1] == p["total_cost"]


def test_the_tree_is_not_shuffled(spark, monkeypatch):
    """A round's plan reads the tree's buckets in place: no exchange lies over a layer on its way to what was tried."""
    plans = []

    def record(df, keys, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return bucketed(df, keys, name)

    bucketed = SP.bucketed
    monkeypatch.setattr(SP, "bucketed", record)
    monkeypatch.setattr(SP, "LAYERS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame(random_edges(), "src long, dst long, weight double")
        SP.shortest_path_tree(edges, spark.createDataFrame([(0,), (5,)], "id long")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounds = [p for name, p in plans if name == "fresh"]
    merges = [p for name, p in plans if name == "tree"][1:]
    assert len(rounds) > 3 and merges
    for plan in rounds:
        # the improvements go to their edges, what was tried to its pairs; edges and tree stay
        assert plan.count("Exchange hashpartitioning") == 2, plan
    for plan in merges:
        assert "Exchange" not in plan and "Bucketed: true" in plan


def test_long_cheap_path_is_not_replaced_by_a_short_one(spark):
    chain = [(i, i + 1, 0.01) for i in range(12)] + [(0, 12, 5.0)]
    frame = spark.createDataFrame(chain, "src long, dst long, weight double")
    paths = SP.shortest_paths(frame, spark.createDataFrame([(0,)], "id long"), 10).collect()
    assert {p["target"] for p in paths} == set(range(10))


def test_reach(spark):
    edges = random_edges(m=90)
    frame = spark.createDataFrame([(b, a) for a, b, _ in edges], "src long, dst long")
    want, frontier = {}, {0}
    for hop in range(1, 5):
        frontier = {b for a, b, _ in edges if a in frontier} - set(want)
        want.update({v: hop for v in frontier})
    assert {r["id"]: r["hops"] for r in reach(frame, 0).collect()} == want


@pytest.mark.parametrize("rows_per_part", [1_000_000, 5])
def test_pagerank(spark, rows_per_part):
    edges = random_edges(n=40, m=160)
    nodes = list(range(42))
    sent = {}
    for a, _, w in edges:
        sent[a] = sent.get(a, 0) + w
    score = {n: 0.15 for n in nodes}
    for _ in range(20):
        new = {n: 0.15 for n in nodes}
        for a, b, w in edges:
            new[b] += 0.85 * score[a] * w / sent[a]
        score = new
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    ranks = pagerank(frame, spark.createDataFrame([(n,) for n in nodes], "id long"), rows_per_part=rows_per_part)
    got = {r["id"]: r["score"] for r in ranks.collect()}
    assert got == pytest.approx(score)
    total = sum(score.values())
    assert {r["id"]: r["score"] for r in l1_scale(ranks).collect()} == pytest.approx({n: s / total for n, s in score.items()})


def percentile_of(values, q):
    ordered = sorted(values)
    place = q * (len(values) - 1)
    low = int(place)
    high = ordered[min(low + 1, len(values) - 1)]
    return ordered[low] + (high - ordered[low]) * (place - low) if high != ordered[low] else high


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, q):
    rnd = random.Random(1)
    values = [rnd.choice([rnd.random() - 0.5, 0.25, rnd.random() ** 3, -0.0, 1e300, -1e-310]) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert exact_percentile(frame, "x", q).first()["x"] == percentile_of(values, q)


def test_percentile_of_values_that_lie_close_together(spark):
    rnd = random.Random(2)
    values = [1.0 + rnd.random() * 1e-12 for _ in range(2000)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_percentile(frame, "x", 0.95).first()["x"] == percentile_of(values, 0.95)
    infinite = spark.createDataFrame([(float("inf"),), (float("-inf"),), (2.0,)], "x double")
    assert exact_percentile(infinite, "x", 0.5).first()["x"] == 2.0
    assert exact_percentile(infinite, "x", 1.0).first()["x"] == float("inf")
    assert exact_percentile(frame.limit(0), "x", 0.5).first()["x"] is None


def test_pagerank_stops_when_scores_settle(spark):
    """A chain settles after as many rounds as it is long, a cycle does not within a few."""
    nodes = spark.range(6).select("id")
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)], "src long, dst long, weight double")
    run = pagerank_run(chain, nodes)
    assert run.converged and run.rounds == 5 and run.residual == 0.0
    cycle = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, weight double")
    run = pagerank_run(cycle, nodes, iterations=7)
    assert not run.converged and run.rounds == 7 and run.residual == pytest.approx(0.15 * 0.85**7)
    assert pagerank_run(cycle, nodes, iterations=400, tolerance=1e-3).rounds < 60


def brute_modularity(edges, of):
    m = sum(w for _, _, w in edges)
    total, inner = {}, 0.0
    for a, b, w in edges:
        total[of[a]] = total.get(of[a], 0) + w
        total[of[b]] = total.get(of[b], 0) + w
        inner += w if of[a] == of[b] else 0
    return inner / m - sum(t * t for t in total.values()) / (4 * m * m)


def test_louvain_finds_planted_groups(spark):
    rows_per_part = 4  # every node is hot
    rnd = random.Random(5)
    edges = []
    for g in range(3):
        members = list(range(g * 8, g * 8 + 8))
        edges += [(a, b, 5) for a, b in itertools.combinations(members, 2) if rnd.random() < 0.8]
    edges += [(0, 8, 1), (9, 17, 1), (16, 1, 1), (3, 3, 2)]
    frame = spark.createDataFrame(edges, "src long, dst long, weight long")
    nodes = spark.range(25)  # 24 has no edge
    found = C.louvain(frame, nodes, rows_per_part=rows_per_part)
    of = {r["id"]: r["community"] for r in found.collect()}
    assert sorted(of) == list(range(25))
    assert [of[i] for i in range(24)] == [0] * 8 + [8] * 8 + [16] * 8 and of[24] == 24
    q = C.modularity(frame, found, rows_per_part).first()
    assert q["communities"] == 4 and q["modularity"] == pytest.approx(brute_modularity(edges, of))
    alone = {i: i for i in range(25)}
    assert q["modularity"] > brute_modularity(edges, alone)
    again = {r["id"]: r["community"] for r in C.louvain(frame, nodes).collect()}
    assert again == of
    run = C.louvain_run(frame, nodes)
    assert run.settled and run.community_count == 4 and run.modularity == pytest.approx(q["modularity"])
    qs = [level.modularity for level in run.levels]
    assert qs == sorted(qs) and [level.communities for level in run.levels] == sorted((level.communities for level in run.levels), reverse=True)


def test_louvain_says_when_it_did_not_settle(spark):
    edges = [(a, b, 1) for g in range(4) for a, b in itertools.combinations(range(g * 5, g * 5 + 5), 2)]
    edges += [(0, 5, 1), (5, 10, 1), (10, 15, 1)]
    frame = spark.createDataFrame(edges, "src long, dst long, weight long")
    short = C.louvain_run(frame, spark.range(20), max_levels=1, max_iterations=1)
    assert not short.settled
    none = C.louvain_run(frame.limit(0), spark.range(3))
    assert none.settled and none.levels == [] and none.community_count == 3 and none.modularity == 0.0


def test_a_louvain_turn_writes_one_table(spark, monkeypatch):
    """A turn that writes sums, hot keys and moves one after the other takes its time in jobs, not in links."""
    written, write = [], C.materialise

    def noted(df, name="step"):
        written.append(name)
        return write(df, name)

    monkeypatch.setattr(C, "materialise", noted)
    monkeypatch.setattr("chaintrail.operators.skew.materialise", noted)
    edges = [(a, b, 1) for g in range(3) for a, b in itertools.combinations(range(g * 5, g * 5 + 5), 2)] + [(0, 5, 1), (5, 10, 1), (99, 1, 1)]
    run = C.louvain_run(spark.createDataFrame(edges, "src long, dst long, weight long"), spark.range(15))  # 99 is no node
    assert {r["id"]: r["community"] for r in run.membership.collect()} == {i: i - i % 5 for i in range(15)}
    turns = written.count("judged")
    assert turns >= sum(level.turns for level in run.levels) > 4
    assert written.count("community-sums") == 0 and written.count("hot-keys") < turns + 5


def test_nodes_and_edges_come_from_one_scan(spark):
    records = raw(
        spark,
        {"ID": "1", "ANIMALS": [("BOVINO,FEMEA,0 A 12", 5), ("BOVINO,MACHO,13 A 24", None)]},
        {"ID": "2", "ANIMALS": None, "SLAUGHTER_GTA": True, "DESTINATION_CODE": "S"},
        {"ID": "2", "ANIMALS": [], "SLAUGHTER_GTA": True, "DESTINATION_CODE": "S"},
        {"ID": "3", "SLAUGHTER_GTA": None},
    )
    permits, animals = P.normalise_permits(records), P.permit_animals(records)
    graph = P.build_graph(permits, animals, [2018], F.col("gta_id").cast("long"))
    keys = {"Farm": "id", "Slaughterhouse": "id", "City": "geocode", "State": "name", "GTA": "gta_id", "Code": "code", "Animal_Type": "animal_type"}
    want = {(label, r[0]) for label, frame in graph.nodes.items() for r in frame.select(keys.get(label, frame.columns[0])).collect()}
    nodes = P.node_keys(records)
    assert {tuple(r) for r in nodes.collect()} == want and nodes.count() == len(want)
    edges = P.edge_pairs(records)
    listed = sorted((kind, str(r["src"]), str(r["dst"])) for kind, frame in graph.edges.items() for r in frame.select("src", "dst").collect())
    assert sorted(map(tuple, edges.collect())) == listed
    for frame in (nodes, edges):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") + plan.count("Generate") >= 1 and plan.count("LogicalRDD") <= 1


def test_second_degree_groups_skip_direct_senders(spark):
    groups = spark.createDataFrame(
        [
            ("a", 1, 9, "Slaughterhouse", 1, "F", 0, 12, date(2018, 1, 1), 2018),
            ("b", 2, 1, "Farm", 1, "F", 0, 12, date(2018, 1, 1), 2018),
            ("c", 3, 1, "Farm", 1, "F", 0, 12, date(2018, 1, 1), 2018),
        ],
        GROUP_SCHEMA,
    )
    flows = spark.createDataFrame([(1, 9), (3, 9)], "src long, dst long")
    got = S.second_degree_groups(groups, flows, 9, F.col("farm_id") == 1).collect()
    assert [tuple(r) for r in got] == [("a", 1, "b", 2)]


@pytest.mark.parametrize("hops", [0, 1, 2])
def test_chains_need_few_permits(spark, hops):
    """All degrees from the permits of the chains alone: reading every permit's lines made the export grow with all of them."""
    groups = random_groups(160)
    groups = [(*r[:2], 99 if r[3] == "Slaughterhouse" else r[2], *r[3:]) for r in groups]
    far = [(f"far{i}", 500 + i, 600 + i, "Farm", *r[4:]) for i, r in enumerate(groups[:20])]
    frame = spark.createDataFrame(groups + far + [("none", None, None, *groups[0][3:])], GROUP_SCHEMA)
    permits = frame.withColumns({"year": F.col("transport_year"), "gta_id": F.col("id")})
    chain = S.chain_permits(permits, 99, [2018, 2019], hops)
    assert chain.columns == permits.columns
    few = chain.drop("year", "gta_id")
    assert few.count() < len(groups) and few.where("id LIKE 'far%'").isEmpty()
    names = S.DEGREES[: hops + 1]
    want, got = (sorted(map(tuple, S.supplier_degrees(g, 99, [2018, 2019], names).collect())) for g in (frame, few))
    assert got == want and {r[2] for r in got} == set(names)
