"""Registered queries on the permit graph: flows, groups, suppliers, reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.functions.measures import significant, whole_months
from chaintrail.operators import groups as G
from chaintrail.operators import permits as P
from chaintrail.operators import suppliers as S
from chaintrail.operators.groups import could_come_from, mark_compatible
from chaintrail.operators.paths import weighted
from chaintrail.operators.reach import reach, reach_in_city
from chaintrail.plans import fixtures as fx
from chaintrail.plans.sql_parts import signed_months, sql
from chaintrail.session import materialise, new_scratch
from chaintrail.sources.permits_json import read_permits
from chaintrail.sources.tables import export_csv, read_export

QUERIES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return register


@query(
    "top_slaughterhouses",
    sql(
        """
    SELECT c.n_name AS city, s_name AS slaughterhouse_name, CAST(s_suppkey AS VARCHAR) AS slaughterhouse_taxnumber,
           CAST(sum(total_sent) AS BIGINT) AS animals_received
    FROM flows JOIN supplier ON dst = s_suppkey * 2 + 1 JOIN nation c ON c.n_nationkey = s_nationkey
    WHERE dst_label = 'Slaughterhouse'
    GROUP BY 1, 2, 3 ORDER BY animals_received DESC, slaughterhouse_taxnumber, city LIMIT 5""",
        "flows",
    ),
)
def top_slaughterhouses(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_receivers(fx.flows(spark, sf), fx.slaughter_places(spark, sf), fx.cities(spark, sf), fx.slaughterhouses(spark, sf))


@query("sends_to", sql("SELECT * FROM flows", "flows"))
def sends_to(spark: SparkSession, sf: str) -> DataFrame:
    return fx.flows(spark, sf)


def _json_permits(spark: SparkSession, sf: str) -> DataFrame:
    path = new_scratch(spark, "permits-json")
    fx.raw_permits(spark, sf).write.json(path)
    return read_permits(spark, path)


@query(
    "gta_scan",
    sql(
        """
    SELECT gta_id, gta_date, year, slaughter_gta, origin_id, dest_id, dest_label, origin_geocode, origin_city, dest_geocode, dest_city,
           transport, purpose, gta_source, species, purpose AS info_status
    FROM raw""",
        "raw",
    ),
)
def gta_scan(spark: SparkSession, sf: str) -> DataFrame:
    return P.normalise_permits(_json_permits(spark, sf)).select(
        "gta_id", "gta_date", "year", "slaughter_gta", "origin_id", "dest_id", "dest_label", "origin_geocode", "origin_city",
        "dest_geocode", "dest_city", "transport", "purpose", "gta_source", "species", "info_status",
    )


@query("gta_totals", sql("SELECT gta_id, CAST(amount0 + amount1 AS BIGINT) AS total_animals FROM raw", "raw"))
def gta_totals(spark: SparkSession, sf: str) -> DataFrame:
    return P.array_total(fx.raw_permits(spark, sf))


@query(
    "gta_animals",
    sql(
        """
    SELECT concat(gta_id, '#0') AS line_id, gta_id, 'BOVINO,FEMEA,0 A 12 MESES' AS description, amount0 AS amount FROM raw
    UNION ALL SELECT concat(gta_id, '#1'), gta_id, 'BOVINO,MACHO,ACIMA DE 36 MESES', amount1 FROM raw""",
        "raw",
    ),
)
def gta_animals(spark: SparkSession, sf: str) -> DataFrame:
    return P.permit_animals(fx.raw_permits(spark, sf))


@query(
    "gta_destinations",
    sql("SELECT gta_id, dest_id, dest_label AS kind FROM raw WHERE slaughter_gta IS NOT NULL", "raw"),
)
def gta_destinations(spark: SparkSession, sf: str) -> DataFrame:
    to_farms, to_slaughter = P.split_destinations(P.normalise_permits(fx.raw_permits(spark, sf)))
    return to_farms.select("gta_id", "dest_id", F.lit(P.FARM).alias("kind")).union(
        to_slaughter.select("gta_id", "dest_id", F.lit(P.SLAUGHTERHOUSE))
    )


@query(
    "city_nodes",
    sql(
        """
    SELECT geocode, arg_min(name, seq) AS name
    FROM (SELECT origin_geocode AS geocode, origin_city AS name, o_orderkey * 2 AS seq FROM raw
          UNION ALL SELECT dest_geocode, dest_city, o_orderkey * 2 + 1 FROM raw) GROUP BY 1""",
        "raw",
    ),
)
def city_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return P.city_nodes(P.normalise_permits(fx.raw_permits(spark, sf)), F.col("gta_id").cast("long"))


@query(
    "graph_nodes",
    sql(
        """
    SELECT DISTINCT label, key FROM (
        SELECT 'Farm' AS label, origin_id AS key FROM raw
        UNION ALL SELECT 'Farm', dest_id FROM raw WHERE NOT slaughter_gta
        UNION ALL SELECT 'Slaughterhouse', dest_id FROM raw WHERE slaughter_gta
        UNION ALL SELECT 'City', origin_geocode FROM raw UNION ALL SELECT 'City', dest_geocode FROM raw
        UNION ALL SELECT 'State', origin_state FROM raw UNION ALL SELECT 'State', dest_state FROM raw
        UNION ALL SELECT 'GTA', gta_id FROM raw
        UNION ALL SELECT 'Transport', transport FROM raw UNION ALL SELECT 'Purpose', purpose FROM raw
        UNION ALL SELECT 'GTA_Source', gta_source FROM raw UNION ALL SELECT 'Species', species FROM raw
        UNION ALL SELECT 'Code', origin_code FROM raw UNION ALL SELECT 'Code', dest_code FROM raw
        UNION ALL SELECT 'Animal_Type', d FROM (VALUES ('BOVINO,FEMEA,0 A 12 MESES'), ('BOVINO,MACHO,ACIMA DE 36 MESES')) v(d))""",
        "raw",
    ),
)
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return P.node_keys(_json_permits(spark, sf))


@query(
    "graph_edges",
    sql(
        """
    SELECT DISTINCT 'CITY_IS_LOCATED_IN' AS type, origin_geocode AS src, origin_state AS dst FROM raw
    UNION SELECT 'CITY_IS_LOCATED_IN', dest_geocode, dest_state FROM raw
    UNION SELECT 'FARM_IS_LOCATED_IN', origin_id, origin_geocode FROM raw
    UNION SELECT 'FARM_IS_LOCATED_IN', dest_id, dest_geocode FROM raw WHERE NOT slaughter_gta
    UNION SELECT 'SLAUGHTERHOUSE_IS_LOCATED_IN', dest_id, dest_geocode FROM raw WHERE slaughter_gta
    UNION SELECT 'FARM_HAS_CODE', origin_id, origin_code FROM raw
    UNION SELECT 'FARM_HAS_CODE', dest_id, dest_code FROM raw WHERE NOT slaughter_gta
    UNION SELECT 'SLAUGHTERHOUSE_HAS_CODE', dest_id, dest_code FROM raw WHERE slaughter_gta
    UNION SELECT 'SENDS_TO', origin_id, dest_id FROM raw WHERE dest_id IS NOT NULL
    UNION ALL SELECT 'IS_TRANSPORTED_BY', gta_id, transport FROM raw
    UNION ALL SELECT 'HAS_PURPOSE', gta_id, purpose FROM raw
    UNION ALL SELECT 'FROM_GTA_SOURCE', gta_id, gta_source FROM raw
    UNION ALL SELECT 'SPECIES_TRANSPORTED', gta_id, species FROM raw
    UNION ALL SELECT 'IS_ORIGIN_OF_GTA', origin_id, gta_id FROM raw
    UNION ALL SELECT 'GTA_HAS_DESTINATION', gta_id, dest_id FROM raw WHERE dest_id IS NOT NULL
    UNION ALL SELECT 'ANIMAL_TYPE_SENT', gta_id, 'BOVINO,FEMEA,0 A 12 MESES' FROM raw
    UNION ALL SELECT 'ANIMAL_TYPE_SENT', gta_id, 'BOVINO,MACHO,ACIMA DE 36 MESES' FROM raw""",
        "raw",
    ),
)
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return P.edge_pairs(_json_permits(spark, sf))


@query("animal_groups", sql("SELECT * FROM grp", "grp"))
def animal_groups(spark: SparkSession, sf: str) -> DataFrame:
    return fx.groups(spark, sf)


@query("could_come_from", sql("SELECT ag1, ag2, possible_animals, month_intersection FROM ccf", "ccf"))
def ccf(spark: SparkSession, sf: str) -> DataFrame:
    groups = materialise(fx.groups(spark, sf), "groups")
    return could_come_from(groups, groups).select("ag1", "ag2", "possible_animals", "month_intersection")


@query(
    "month_diff",
    f"""
    SELECT o_orderkey, l_linenumber, CAST({signed_months("CAST(o_orderdate AS DATE)", "CAST(l_shipdate AS DATE)")} AS INTEGER) AS months,
           CAST({signed_months("CAST(l_shipdate AS DATE)", "CAST(o_orderdate AS DATE)")} AS INTEGER) AS months_back
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def month_diff(spark: SparkSession, sf: str) -> DataFrame:
    joined = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start, end = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    return joined.select(
        "o_orderkey", "l_linenumber", whole_months(start, end).alias("months"), whole_months(end, start).alias("months_back")
    )


@query(
    "first_degree_farm_count",
    sql("SELECT count(DISTINCT src) AS first_degree_farms FROM flows WHERE dst = 1", "flows"),
)
def first_degree_farm_count(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_degree_farms(fx.flows(spark, sf), fx.TARGET)


@query("farms_in_city", "SELECT count(DISTINCT c_custkey) AS farms FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def farms_in_city(spark: SparkSession, sf: str) -> DataFrame:
    city = fx.cities(spark, sf).where(F.col("name") == fx.SAMPLE_CITY)
    return (
        fx.farm_places(spark, sf)
        .join(city.select(F.col("geocode").alias("dst")), "dst", "left_semi")
        .agg(F.countDistinct("src").alias("farms"))
    )


@query(
    "farm_inflow",
    sql(
        """
    SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) AS animals_sent, count(*) AS animal_groups, count(DISTINCT origin_id) AS farms
    FROM grp WHERE dest_id = 42 AND dest_label = 'Farm'""",
        "grp",
    ),
)
def farm_inflow(spark: SparkSession, sf: str) -> DataFrame:
    return S.farm_inflow(fx.groups(spark, sf), fx.SAMPLE_FARM)


@query(
    "second_degree_sample",
    sql(
        """
    SELECT a.id AS ag1, a.origin_id AS farm_id, b.id AS ag2, b.origin_id AS second_farm_id
    FROM grp a JOIN grp b ON a.origin_id = b.dest_id
    WHERE a.dest_id = 1 AND b.dest_label = 'Farm'
      AND a.origin_id = (SELECT min(origin_id) FROM grp WHERE dest_id = 1)
      AND b.origin_id NOT IN (SELECT src FROM flows WHERE dst = 1)
    ORDER BY 1, 3 LIMIT 3""",
        "grp",
        "flows",
    ),
)
def second_degree_sample(spark: SparkSession, sf: str) -> DataFrame:
    groups = materialise(fx.groups(spark, sf), "groups")
    via = groups.where(F.col("dest_id") == fx.TARGET).agg(F.min("origin_id")).scalar()
    return S.second_degree_groups(groups, fx.flows(spark, sf), fx.TARGET, F.col("farm_id") == via, limit=3)


def _degrees(spark: SparkSession, sf: str, degrees: tuple[str, ...] = S.DEGREES) -> DataFrame:
    # the permits of a chain first: only their lines are read on, and no other line is shuffled
    chain = S.chain_permits(fx.permits(spark, sf), fx.TARGET, fx.SHED_YEARS, max(S.DEGREES.index(d) for d in degrees))
    lines = fx.animals(spark, sf).join(chain.select("gta_id"), "gta_id", "left_semi")
    groups = materialise(G.animal_groups(chain, lines), "groups")
    return S.supplier_degrees(groups, fx.TARGET, fx.SHED_YEARS, degrees)


for _degree, _part in zip(S.DEGREES, ("first_deg", "second_deg", "third_deg"), strict=True):
    QUERIES[_degree] = (
        lambda spark, sf, degree=_degree: S.one_degree(_degrees(spark, sf, (degree,)), degree),
        sql(f"SELECT * FROM {_part}", _part),
    )

_SHED_COLUMNS = ", ".join(f"{d}_{y}" for y in fx.SHED_YEARS for d in S.DEGREES)
_SHED = sql(
    f"SELECT c_name AS Farm_name, CAST(c_custkey AS VARCHAR) AS Tax_number, {_SHED_COLUMNS} FROM shed JOIN customer ON farm_id = c_custkey * 2",
    "shed",
)


@query("supply_shed", _SHED)
def supply_shed(spark: SparkSession, sf: str) -> DataFrame:
    return S.supply_shed(_degrees(spark, sf), fx.farms(spark, sf), fx.SHED_YEARS)


@query("supply_shed_export", _SHED)
def supply_shed_export(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered CSV export, read back."""
    path = new_scratch(spark, "supply-shed")
    shed = supply_shed(spark, sf)
    export_csv(shed, path)
    return read_export(spark, path, ", ".join(f"{c} {t}" for c, t in shed.dtypes))


@query(
    "supply_shed_city",
    sql(
        f"""
    SELECT n_name AS City_name, CAST(n_nationkey AS VARCHAR) AS City_geocode, c_name AS Farm_name, CAST(c_custkey AS VARCHAR) AS Tax_number,
           {_SHED_COLUMNS}
    FROM shed JOIN customer ON farm_id = c_custkey * 2 JOIN nation ON c_nationkey = n_nationkey""",
        "shed",
    ),
)
def supply_shed_city(spark: SparkSession, sf: str) -> DataFrame:
    cities = fx.cities(spark, sf).select(F.col("geocode").alias("city_geocode"), F.col("name").alias("city_name"))
    places = fx.farm_places(spark, sf).select(F.col("src").alias("farm_id"), F.col("dst").alias("city_geocode")).join(cities, "city_geocode")
    return S.supply_shed(_degrees(spark, sf), fx.farms(spark, sf), fx.SHED_YEARS, places)


def _flow_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(fx.flows(spark, sf).select("src", "dst"), "flow-pairs")


@query("reach_1_4", sql("SELECT id, CAST(hops AS INTEGER) AS hops FROM reached", "reached", recursive=True))
def reach_1_4(spark: SparkSession, sf: str) -> DataFrame:
    return reach(_flow_pairs(spark, sf), fx.TARGET)


@query(
    "reach_in_city",
    sql(
        """
    SELECT id, CAST(hops AS INTEGER) AS hops FROM reached JOIN customer ON id = c_custkey * 2 JOIN nation ON c_nationkey = n_nationkey
    WHERE n_name = 'NATION_3'""",
        "reached",
        recursive=True,
    ),
)
def reach_in_city_query(spark: SparkSession, sf: str) -> DataFrame:
    city = fx.cities(spark, sf).where(F.col("name") == fx.SAMPLE_CITY).select("geocode")
    return reach_in_city(_flow_pairs(spark, sf), fx.TARGET, fx.farm_places(spark, sf), city)


@query("target_year_edges", sql("SELECT * FROM first_edge", "first_edge"))
def target_year_edges(spark: SparkSession, sf: str) -> DataFrame:
    return fx.first_edges(spark, sf)


@query("compatible_groups", sql("SELECT id, possible_source FROM marked", "marked"))
def compatible_groups(spark: SparkSession, sf: str) -> DataFrame:
    return mark_compatible(fx.groups(spark, sf), fx.TARGET_YEAR).select("id", "possible_source")


@query("compatible_edges", sql("SELECT * FROM next_edge", "next_edge"))
def compatible_edges(spark: SparkSession, sf: str) -> DataFrame:
    return fx.next_edges(spark, sf)


@query(
    "weighted_edges",
    sql(
        """
    SELECT *, CAST(printf('%.8e', 1.0::DOUBLE / (total + 1)) AS DOUBLE) AS path_weight
    FROM (SELECT * FROM first_edge UNION ALL SELECT * FROM next_edge)""",
        "first_edge",
        "next_edge",
    ),
)
def weighted_edges(spark: SparkSession, sf: str) -> DataFrame:
    both = weighted(fx.first_edges(spark, sf)).unionByName(weighted(fx.next_edges(spark, sf)))
    return both.withColumn("path_weight", significant(F.col("path_weight")))
