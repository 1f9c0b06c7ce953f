"""Registered queries on ranking, communities and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.functions.measures import path_length, significant
from chaintrail.operators import communities as C
from chaintrail.operators import path_search as PS
from chaintrail.operators import paths as SP
from chaintrail.operators import ranking as R
from chaintrail.plans import fixtures as fx
from chaintrail.plans.sql_parts import sql
from chaintrail.session import materialise

QUERIES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return register


def _rank_sql(body: str) -> str:
    """Twenty rounds written out, then `body` over rank(id, tax_number, name, label, score, scaled)."""
    head = sql("", "share", "nodes").rstrip()
    rounds = ["r0 AS (SELECT id, 0.15 AS score FROM nodes)"]
    for i in range(1, R.ITERATIONS + 1):
        rounds.append(
            f"r{i} AS MATERIALIZED (SELECT n.id, 0.15 + coalesce(x.s, 0) AS score FROM nodes n LEFT JOIN "
            f"(SELECT e.dst, sum(e.share * p.score) AS s FROM share e JOIN r{i - 1} p ON p.id = e.src GROUP BY 1) x ON x.dst = n.id)"
        )
    rounds.append(
        f"rank AS (SELECT n.*, r.score, r.score / (SELECT sum(abs(score)) FROM r{R.ITERATIONS}) AS scaled "
        f"FROM nodes n JOIN r{R.ITERATIONS} r ON r.id = n.id)"
    )
    return head + ",\n" + ",\n".join(rounds) + "\n" + body


def _run(spark: SparkSession, sf: str) -> R.RankRun:
    return R.pagerank_run(fx.flow_graph(spark, sf), fx.named_nodes(spark, sf).select("id"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).scores


@query(
    "pagerank_convergence",
    _rank_sql(
        f"""SELECT {R.ITERATIONS} AS rounds, CAST(printf('%.5e', max(abs(a.score - b.score))) AS DOUBLE) AS residual,
                   max(abs(a.score - b.score)) < {R.TOLERANCE!r} AS converged
            FROM r{R.ITERATIONS} a JOIN r{R.ITERATIONS - 1} b USING (id)"""
    ),
)
def pagerank_convergence(spark: SparkSession, sf: str) -> DataFrame:
    """How many rounds were run, and how much the last one changed."""
    run = _run(spark, sf)
    row = spark.createDataFrame([(run.rounds, run.residual, run.converged)], "rounds int, residual double, converged boolean")
    return row.withColumn("residual", significant(F.col("residual"), 6))


def _top(scores: DataFrame, names: DataFrame, k: int) -> DataFrame:
    # rounding first makes the order the same on every engine
    return R.top_ranked(scores.withColumn("score", significant(F.col("score"))), names, k)


def _ranked(score: str, where: str, k: int) -> str:
    return _rank_sql(
        f"SELECT name, tax_number, CAST(printf('%.8e', {score}) AS DOUBLE) AS score FROM rank WHERE {where} ORDER BY score DESC, name, tax_number LIMIT {k}"
    )


@query("pagerank_top_slaughterhouses", _ranked("score", "label = 'Slaughterhouse'", 100))
def pagerank_top_slaughterhouses(spark: SparkSession, sf: str) -> DataFrame:
    return _top(_scores(spark, sf), fx.slaughterhouses(spark, sf), 100)


@query("pagerank_top_all", _ranked("scaled", "true", 100))
def pagerank_top_all(spark: SparkSession, sf: str) -> DataFrame:
    return _top(R.l1_scale(_scores(spark, sf)), fx.named_nodes(spark, sf), 100)


@query("pagerank_top_farms", _ranked("scaled", "label = 'Farm'", 5))
def pagerank_top_farms(spark: SparkSession, sf: str) -> DataFrame:
    return _top(R.l1_scale(_scores(spark, sf)), fx.farms(spark, sf), 5)


@query("pagerank_top_100_farms", _ranked("scaled", "label = 'Farm'", 100))
def pagerank_top_100_farms(spark: SparkSession, sf: str) -> DataFrame:
    return _top(R.l1_scale(_scores(spark, sf)), fx.farms(spark, sf), 100)


@query("pagerank_l1", _rank_sql("SELECT id, CAST(printf('%.8e', scaled) AS DOUBLE) AS score FROM rank"))
def pagerank_l1(spark: SparkSession, sf: str) -> DataFrame:
    return R.l1_scale(_scores(spark, sf)).withColumn("score", significant(F.col("score")))


@query("pagerank_p95", _rank_sql("SELECT CAST(printf('%.8e', quantile_cont(scaled, 0.95)) AS DOUBLE) AS score FROM rank WHERE label = 'Farm'"))
def pagerank_p95(spark: SparkSession, sf: str) -> DataFrame:
    scores = R.l1_scale(_scores(spark, sf)).join(fx.farms(spark, sf), "id", "left_semi")
    return R.exact_percentile(scores, "score", 0.95).withColumn("score", significant(F.col("score")))


def _by_city(spark: SparkSession, sf: str) -> DataFrame:
    """A partition both engines can state: nodes of a city are one community."""
    places = fx.farm_places(spark, sf).union(fx.slaughter_places(spark, sf))
    return places.select(F.col("src").alias("id"), F.col("dst").alias("community"))


_CITY_OF = (
    "SELECT c_custkey * 2 AS id, CAST(c_nationkey AS VARCHAR) AS community FROM customer "
    "UNION ALL SELECT s_suppkey * 2 + 1, CAST(s_nationkey AS VARCHAR) FROM supplier"
)


@query(
    "modularity",
    sql(
        f"""
    , city_of AS MATERIALIZED ({_CITY_OF}),
    ends AS MATERIALIZED (SELECT a.community AS a, b.community AS b, total_sent AS w
                          FROM flows JOIN city_of a ON a.id = src JOIN city_of b ON b.id = dst),
    deg AS (SELECT c, sum(w) AS t FROM (SELECT a AS c, w FROM ends UNION ALL SELECT b, w FROM ends) GROUP BY 1)
    SELECT (SELECT count(DISTINCT community) FROM city_of) AS communities,
           round((SELECT sum(w) FROM ends WHERE a = b)::DOUBLE / (SELECT sum(w) FROM ends)
               - (SELECT sum(t::DOUBLE * t) FROM deg) / ((SELECT sum(t) FROM deg)::DOUBLE * (SELECT sum(t) FROM deg)), 9) AS modularity""",
        "flows",
    ),
)
def modularity(spark: SparkSession, sf: str) -> DataFrame:
    graph = materialise(fx.flow_graph(spark, sf), "flow-graph")
    return C.modularity(graph, _by_city(spark, sf)).withColumn("modularity", F.round("modularity", 9))


@query("community_sizes", f"SELECT community, count(*) AS node_amount FROM ({_CITY_OF}) GROUP BY 1 HAVING count(*) > 20 ORDER BY node_amount DESC, community")
def community_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return C.community_sizes(_by_city(spark, sf))


@query(
    "community_size_of",
    f"WITH c AS ({_CITY_OF}) SELECT count(DISTINCT id) AS nodes FROM c WHERE community = (SELECT community FROM c WHERE id = 1)",
)
def community_size_of(spark: SparkSession, sf: str) -> DataFrame:
    return C.community_size_of(_by_city(spark, sf), fx.TARGET)


_STARS = """
    WITH hub AS MATERIALIZED (SELECT c_nationkey AS nation, min(c_custkey) * 2 AS hub FROM customer GROUP BY 1),
    star AS MATERIALIZED (SELECT hub AS src, c_custkey * 2 AS dst, 1000 + c_custkey % 7 AS weight FROM customer JOIN hub ON nation = c_nationkey),
    ring AS MATERIALIZED (SELECT a.hub AS src, b.hub AS dst, 1 AS weight FROM hub a JOIN hub b ON b.nation = (a.nation + 1) % 25)"""


def _star_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The customers of each nation around the first of them, and a weak ring through the nations."""
    customers = fx.table(spark, sf, "customer").select("c_nationkey", (F.col("c_custkey") * 2).alias("dst"), "c_custkey")
    hubs = customers.groupBy("c_nationkey").agg(F.min("dst").alias("src"))
    stars = customers.join(hubs, "c_nationkey").select("src", "dst", (1000 + F.col("c_custkey") % 7).alias("weight"))
    after = hubs.select(F.col("c_nationkey").alias("next"), F.col("src").alias("dst"))
    ring = hubs.join(after, F.col("next") == (F.col("c_nationkey") + 1) % 25).select("src", "dst", F.lit(1).cast("long").alias("weight"))
    return materialise(stars.unionByName(ring), "star-graph")


def _planted(spark: SparkSession, sf: str) -> C.LouvainRun:
    return C.louvain_run(_star_graph(spark, sf), fx.farms(spark, sf).select("id"))


@query("louvain_planted", _STARS + " SELECT dst AS id, src AS community FROM star")
def louvain_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of a graph in which they are known: one for each nation."""
    return _planted(spark, sf).membership


@query(
    "louvain_summary",
    _STARS
    + """,
    edge AS (SELECT * FROM star UNION ALL SELECT * FROM ring),
    ends AS (SELECT a.src AS a, b.src AS b, e.weight AS w FROM edge e JOIN star a ON a.dst = e.src JOIN star b ON b.dst = e.dst),
    deg AS (SELECT c, sum(w) AS t FROM (SELECT a AS c, w FROM ends UNION ALL SELECT b, w FROM ends) GROUP BY 1)
    SELECT (SELECT count(*) FROM hub) AS communities, true AS settled,
           round((SELECT sum(w) FROM ends WHERE a = b)::DOUBLE / (SELECT sum(w) FROM ends)
               - (SELECT sum(t::DOUBLE * t) FROM deg) / ((SELECT sum(t) FROM deg)::DOUBLE * (SELECT sum(t) FROM deg)), 9) AS modularity""",
)
def louvain_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What the run on the planted graph reports of itself."""
    run = _planted(spark, sf)
    row = (run.community_count, round(run.modularity, 9), run.settled)
    return spark.createDataFrame([row], "communities long, modularity double, settled boolean")


@query("louvain")
def louvain(spark: SparkSession, sf: str) -> DataFrame:
    graph = materialise(fx.flow_graph(spark, sf), "flow-graph")
    return C.louvain(graph, fx.named_nodes(spark, sf).select("id"), in_task=C.LINKS_IN_TASK)


def _path_graph(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(fx.path_graph(spark, sf), "path-graph")


@query(
    "shortest_paths",
    sql(
        "SELECT source, target, CAST(printf('%.8e', cost) AS DOUBLE) AS total_cost, CAST(hops AS INTEGER) AS path_length FROM tree WHERE hops <= 9",
        "tree",
        recursive=True,
    ),
)
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Cost and length per pair; which of several equal paths is listed is free."""
    paths = SP.shortest_paths(_path_graph(spark, sf), fx.slaughterhouses(spark, sf).select("id"), steps_in_task=SP.BROADCAST_STEPS)
    return paths.select("source", "target", significant(F.col("total_cost")).alias("total_cost"), path_length(F.col("node_ids")).alias("path_length"))


@query(
    "nearest_slaughterhouse",
    sql(
        """
    SELECT n.id AS target, n.name AS farm_name, n.tax_number, length AS path_length, CAST(printf('%.8e', cost) AS DOUBLE) AS total_cost,
           CAST(source AS BIGINT) AS source
    FROM (SELECT target AS t, b.h AS length, b.c AS cost, b.s AS source
          FROM (SELECT target, min({'h': CAST(hops AS INTEGER), 'c': cost, 's': source}) AS b
                FROM tree WHERE hops <= 9 AND target % 2 = 0 GROUP BY 1))
    JOIN nodes n ON n.id = t
    WHERE length >= 2""",
        "tree",
        "nodes",
        recursive=True,
    ),
)
def nearest_slaughterhouse(spark: SparkSession, sf: str) -> DataFrame:
    farms = fx.farms(spark, sf).select(F.col("id").alias("target"), F.col("name").alias("farm_name"), "tax_number")
    tree = SP.shortest_path_tree(_path_graph(spark, sf), fx.slaughterhouses(spark, sf).select("id"), nearest_to=farms, steps_in_task=SP.BROADCAST_STEPS)
    return SP.nearest_source(tree, farms).withColumn("total_cost", significant(F.col("total_cost")))


def _to_sample_farm(spark: SparkSession, sf: str) -> DataFrame:
    return PS.search_to(_path_graph(spark, sf), fx.SAMPLE_FARM)


@query(
    "reachable_slaughterhouses",
    sql("SELECT count(DISTINCT source) AS reachable_slaughterhouses FROM tree WHERE hops <= 9 AND target = 42", "tree", recursive=True),
)
def reachable_slaughterhouses(spark: SparkSession, sf: str) -> DataFrame:
    return PS.count_reaching(_to_sample_farm(spark, sf), fx.slaughterhouses(spark, sf))


@query(
    "cheapest_paths",
    sql(
        """
    SELECT source, name AS slaughterhouse_name, CAST(printf('%.8e', cost) AS DOUBLE) AS total_cost, CAST(hops AS INTEGER) AS path_length
    FROM tree JOIN nodes ON id = source WHERE hops <= 9 AND target = 42 ORDER BY cost, source LIMIT 5""",
        "tree",
        "nodes",
        recursive=True,
    ),
)
def cheapest_paths(spark: SparkSession, sf: str) -> DataFrame:
    sources = fx.slaughterhouses(spark, sf).select("id", F.col("name").alias("slaughterhouse_name"))
    best = PS.cheapest_reaching(_to_sample_farm(spark, sf), sources)
    return best.withColumnRenamed("id", "source").withColumn("total_cost", significant(F.col("total_cost")))


@query(
    "path_subgraph",
    sql(
        """
    , walk AS MATERIALIZED (SELECT * FROM (
        WITH RECURSIVE up(node) AS (
            SELECT target FROM tree WHERE source = 1 AND target = 42 AND hops <= 9
            UNION ALL SELECT t.pred FROM up JOIN tree t ON t.source = 1 AND t.target = up.node WHERE t.pred IS NOT NULL)
        SELECT node FROM up))
    SELECT 'first' AS kind, * FROM first_edge WHERE src = 1 AND dst IN (SELECT node FROM walk)
    UNION ALL SELECT 'next', * FROM next_edge WHERE src IN (SELECT node FROM walk) AND dst IN (SELECT node FROM walk)""",
        "tree",
        recursive=True,
    ),
)
def path_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    first, later = materialise(fx.first_edges(spark, sf), "first"), materialise(fx.next_edges(spark, sf), "next")
    graph = SP.project(SP.weighted(first).unionByName(SP.weighted(later)), "path_weight")
    on_path = PS.nodes_on_path(PS.search_to(graph, fx.SAMPLE_FARM), fx.TARGET)
    return PS.path_subgraph(on_path, first, later, fx.TARGET)
