"""Registered queries on replication, the facility registry and area allocation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.functions.measures import fingerprint
from chaintrail.functions.text import clean_breaks, map_values, simple_code
from chaintrail.operators import allocate as A
from chaintrail.operators import registry as G
from chaintrail.operators import replicate as R
from chaintrail.operators.columns import duplicates
from chaintrail.plans import fixtures as fx
from chaintrail.plans.sql_parts import sql
from chaintrail.session import new_scratch
from chaintrail.sources import jdbc
from chaintrail.sources.tables import create_database

QUERIES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return register


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return R.with_hash(fx.replica_source(spark, sf)), R.with_hash(fx.replica_dest(spark, sf))


@query(
    "replicate_changes",
    sql(
        """
    SELECT 'insert' AS op, * FROM orders WHERE o_orderkey % 10 IN (0, 1, 3)
    UNION ALL SELECT 'delete', * FROM dest_orders WHERE o_orderkey % 10 = 1 OR o_orderkey >= 1000000000000
    UNION ALL SELECT 'delete', orders.* FROM orders, range(2) WHERE o_orderkey % 10 = 4""",
        "dest_orders",
    ),
)
def replicate_changes(spark: SparkSession, sf: str) -> DataFrame:
    inserts, deletes = R.changes(*_both(spark, sf))
    return inserts.withColumn("op", F.lit("insert")).unionByName(deletes.withColumn("op", F.lit("delete"))).drop(R.HASH)


@query("replicate_apply", sql("SELECT * FROM source_orders", "source_orders"))
def replicate_apply(spark: SparkSession, sf: str) -> DataFrame:
    source, dest = _both(spark, sf)
    return R.apply_changes(dest, *R.changes(source, dest)).drop(R.HASH)


def _log_table(spark: SparkSession) -> str:
    location = new_scratch(spark, "replica")
    name = "replica_" + location.rsplit("-", 1)[-1]
    create_database(spark, name, location)
    return f"{name}.orders"


@query(
    "snapshot_as_of",
    sql("SELECT 0 AS version, * FROM dest_orders UNION ALL SELECT 1, * FROM source_orders", "dest_orders", "source_orders"),
)
def snapshot_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Both versions of a table that was created from the old and replicated to the new orders."""
    name = _log_table(spark)
    R.replicate(fx.replica_dest(spark, sf), name)
    R.replicate(fx.replica_source(spark, sf), name)
    log = spark.table(name)
    first, second = (R.as_of(log, v).drop(R.HASH).withColumn("version", F.lit(v)) for v in (0, 1))
    return first.unionByName(second)


@query(
    "replicate_tables",
    sql(
        """
    SELECT 'orders' AS name, 'changed' AS action, (SELECT count(*) FROM orders WHERE o_orderkey % 10 IN (0, 1, 3)) AS inserted,
           (SELECT count(*) FROM dest_orders WHERE o_orderkey % 10 = 1 OR o_orderkey >= 1000000000000)
               + 2 * (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 4) AS deleted, 1 AS version,
           (SELECT count(*) FROM source_orders) AS rows
    UNION ALL SELECT 'customer', 'unchanged', 0, 0, 0, count(*) FROM customer
    UNION ALL SELECT 'supplier', 'changed', 0, 1, 1, count(*) FROM supplier""",
        "dest_orders",
        "source_orders",
    ),
)
def replicate_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Three tables replicated twice, at the same time: what the second run did, and the rows alive after it."""
    database = _log_table(spark).split(".")[0]
    suppliers, customers = fx.table(spark, sf, "supplier"), fx.table(spark, sf, "customer")
    lowest = suppliers.agg(F.min("s_suppkey").alias("s_suppkey"))
    first = suppliers.unionByName(suppliers.join(lowest, "s_suppkey", "left_semi"))  # one row stands twice
    before = {"orders": lambda: fx.replica_dest(spark, sf), "customer": lambda: customers, "supplier": lambda: first}
    after = {"orders": lambda: fx.replica_source(spark, sf), "customer": lambda: customers, "supplier": lambda: suppliers}
    R.replicate_all(spark, {f"{database}.{t}": read for t, read in before.items()})
    outcomes = R.replicate_all(spark, {f"{database}.{t}": read for t, read in after.items()})
    rows = [(o.table.split(".")[1], o.action, o.inserted, o.deleted, o.version) for o in outcomes]
    report = spark.createDataFrame(rows, "name string, action string, inserted long, deleted long, version int")
    alive = [R.as_of(spark.table(o.table)).agg(F.count("*").alias("rows")).withColumn("name", F.lit(o.table.split(".")[1])) for o in outcomes]
    return report.join(reduce(DataFrame.unionByName, alive), "name")


@query(
    "source_freshness",
    """
    SELECT *, CASE WHEN source_time > TIMESTAMP '1998-01-01 00:00:00' THEN 'newer' WHEN source_time = TIMESTAMP '1998-01-01 00:00:00'
                   THEN 'same' ELSE 'inconsistent' END AS state
    FROM (SELECT max(o_orderdate) AS source_time FROM orders)""",
)
def source_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return R.source_freshness(fx.replica_source(spark, sf), "o_orderdate", "1998-01-01 00:00:00")


_PROBED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}


@query(
    "schema_probe",
    sql(
        " UNION ALL ".join(f"SELECT '{c}' AS name, '{t}' AS type, count({c}) AS filled FROM source_orders" for c, t in _PROBED.items()),
        "source_orders",
    ),
)
def schema_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the replicated table without the refresh field, and how many values each holds."""
    source = fx.replica_source(spark, sf)
    info = dict(R.schema_info(source, ["o_orderdate"]))
    counts = source.agg(*[F.count(c).alias(c) for c in info])
    return counts.unpivot([], list(info), "name", "filled").withColumn("type", map_values(F.col("name"), info))


@query("column_bounds", "SELECT min(o_orderkey) AS lower_bound, max(o_orderkey) AS upper_bound FROM orders")
def column_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return jdbc.column_bounds(fx.replica_source(spark, sf), "o_orderkey")


@query(
    "row_fingerprint",
    """
    SELECT o_orderkey, md5(concat_ws('|', concat(length(CAST(o_orderkey AS VARCHAR)), ':', o_orderkey),
        concat(length(CAST(o_custkey AS VARCHAR)), ':', o_custkey),
        CASE WHEN o_orderstatus = 'P' THEN '-' ELSE concat(length(o_orderstatus), ':', o_orderstatus) END,
        concat(length(o_orderpriority), ':', o_orderpriority))) AS row_hash
    FROM orders""",
)
def row_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", fingerprint(["o_orderkey", "o_custkey", status, "o_orderpriority"]).alias("row_hash")
    )


@query(
    "shifted_copy",
    """
    SELECT o_orderkey, o_custkey, o_orderdate FROM orders
    UNION ALL SELECT o_orderkey + 2, o_custkey, o_orderdate + INTERVAL 2 YEAR FROM orders WHERE o_orderstatus = 'F'""",
)
def shifted_copy(spark: SparkSession, sf: str) -> DataFrame:
    """A table with a shifted copy of some of its rows appended."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    moved = orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey") + 2, "o_custkey", F.expr("o_orderdate + INTERVAL 2 YEAR").alias("o_orderdate"), "o_orderstatus"
    )
    return orders.union(moved).drop("o_orderstatus")


# --- facility registry


def _facilities(spark: SparkSession, sf: str) -> list[DataFrame]:
    src = fx.facility_sources(spark, sf)
    return [
        G.facility_list([src["df1"], src["df2"], src["df3"]], copies_of=2),
        G.facility_list([src["df1_2018"], src["df2_2018"]]),
    ]


def _one_list(spark: SparkSession, sf: str) -> DataFrame:
    first, second = _facilities(spark, sf)
    return first.unionByName(second.withColumn("source_rank", F.col("source_rank") + 1000))


_MATCHED = ", ".join(G.MATCHED_COLUMNS)


@query(
    "facility_union",
    """
    SELECT CASE s_suppkey % 3 WHEN 0 THEN concat('PPA-', s_suppkey) WHEN 1 THEN concat('PA-', s_suppkey)
                ELSE CAST(s_suppkey AS VARCHAR) END AS CODIGO, s_name AS NOMBRE, s_suppkey AS row_id, source_rank
    FROM (SELECT *, 0 AS source_rank FROM supplier WHERE s_nationkey < 15
          UNION ALL SELECT *, 1 FROM supplier WHERE s_nationkey >= 10)""",
)
def facility_union(spark: SparkSession, sf: str) -> DataFrame:
    src = fx.facility_sources(spark, sf)
    return G.union_sources([src["df1"], src["df2"]]).select("CODIGO", "NOMBRE", "row_id", "source_rank")


@query("dedupe_keep_first", sql("SELECT * FROM facilities WHERE source_rank < 1000", "facilities"))
def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return _facilities(spark, sf)[0]


@query(
    "duplicate_codes",
    sql("SELECT CODE, count(*) AS copies FROM listed WHERE source_rank < 1000 GROUP BY 1 HAVING count(*) > 1", "listed"),
)
def duplicate_codes(spark: SparkSession, sf: str) -> DataFrame:
    src = fx.facility_sources(spark, sf)
    return duplicates(G.facility_list([src["df1"], src["df2"], src["df3"]]), "CODE")


@query("clean_text", "SELECT doc_id, replace(replace(text, chr(13), ' '), chr(10), ' ') AS text FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", clean_breaks(F.col("text")).alias("text"))


@query("simple_code", sql("SELECT CODE, CAST(regexp_extract(CODE, '([0-9]+)$', 1) AS INTEGER) AS SIMPLE_CODE FROM listed", "listed"))
def simple_code_query(spark: SparkSession, sf: str) -> DataFrame:
    src = fx.facility_sources(spark, sf)
    every = G.union_sources(list(src.values()))
    return every.select(F.col("CODIGO").alias("CODE"), simple_code(F.col("CODIGO")).alias("SIMPLE_CODE"))


@query("city_parish", sql("SELECT * FROM city_par", "city_par"))
def city_parish(spark: SparkSession, sf: str) -> DataFrame:
    return G.city_parish(fx.city_list(spark, sf), fx.parish_list(spark, sf))


@query(
    "unmatched_codes",
    sql(
        """
    SELECT CODE FROM eu WHERE CODE NOT IN (SELECT CODE FROM facilities)
      AND concat('PPA-', CODE) NOT IN (SELECT CODE FROM facilities) AND concat('PA-', CODE) NOT IN (SELECT CODE FROM facilities)""",
        "eu",
        "facilities",
    ),
)
def unmatched_codes(spark: SparkSession, sf: str) -> DataFrame:
    return G.unmatched_codes(fx.eu_list(spark, sf).select("CODE"), _one_list(spark, sf))


@query("match_facilities", sql(f"SELECT {_MATCHED} FROM matched", "matched"))
def match_facilities(spark: SparkSession, sf: str) -> DataFrame:
    cities = G.city_parish(fx.city_list(spark, sf), fx.parish_list(spark, sf))
    return G.match_facilities(_one_list(spark, sf), fx.eu_list(spark, sf), fx.china_list(spark, sf), cities).select(*G.MATCHED_COLUMNS)


@query(
    "map_remark",
    sql(
        """
    SELECT code, CASE Remark WHEN 'A' THEN 'Aq' WHEN 'A - FISHERY PRODUCTS' THEN 'F Aq' WHEN 'FISHERY PRODUCTS' THEN 'F'
                             WHEN 'AQUACULTURE PRODUCTS/FISHERY PRODUCTS' THEN 'F Aq' WHEN 'AQUACULTURE PRODUCTS' THEN 'Aq'
                             WHEN 'A - AQUACULTURE PRODUCTS' THEN 'Aq' END AS TYPE FROM china""",
        "china",
    ),
)
def map_remark(spark: SparkSession, sf: str) -> DataFrame:
    return G.map_remark(fx.china_list(spark, sf)).select(F.col("APPROVALNO_CLEAN").cast("int").alias("code"), "TYPE")


@query("missing_canton", sql("SELECT count(*) FILTER (WHERE CANTON IS NULL) AS missing, count(*) AS total FROM matched", "matched"))
def missing_canton(spark: SparkSession, sf: str) -> DataFrame:
    return G.missing_canton(match_facilities(spark, sf))


_REGISTRY = sql(
    f"""
    SELECT {_MATCHED}, 'www.acuaculturaypesca.gob.ec' AS SOURCE
    FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(G.FINAL_KEY)}
                                       ORDER BY source_rank, row_id, CHINA_NAME_SYNONYM, ADDRESS, TELEPHONE, CONTACT) AS rn FROM matched)
    WHERE rn = 1""",
    "matched",
)


@query("facility_registry", _REGISTRY)
def facility_registry(spark: SparkSession, sf: str) -> DataFrame:
    return G.facility_registry(
        _facilities(spark, sf), fx.eu_list(spark, sf), fx.china_list(spark, sf), fx.city_list(spark, sf), fx.parish_list(spark, sf)
    )


@query("facility_registry_files", _REGISTRY)
def facility_registry_files(spark: SparkSession, sf: str) -> DataFrame:
    """The registry from its nine CSV files, some of them with line breaks inside fields."""
    lists = fx.facility_sources(spark, sf)
    inputs = {
        "city_df": fx.city_list(spark, sf), "parish_df": fx.parish_list(spark, sf),
        "eu_df": fx.eu_list(spark, sf), "china_df": fx.china_list(spark, sf),
        **{name: df.orderBy("row_id").drop("row_id") for name, df in lists.items()},
    }
    paths = {name: new_scratch(spark, name) for name in inputs}
    for name, df in inputs.items():
        df.write.csv(paths[name], sep=G.INPUT_FILES[name], header=True)
    read = G.registry_inputs(spark, paths)
    first = G.facility_list([read["df1"], read["df2"], read["df3"]], copies_of=2)
    second = G.facility_list([read["df1_2018"], read["df2_2018"]])
    return G.facility_registry([first, second], read["eu_df"], read["china_df"], read["city_df"], read["parish_df"])


# --- allocation by area


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("shrimp_flows", sql("SELECT YEAR, hs6, round(volume_raw, 6) AS volume_raw FROM exports", "exports"))
def shrimp_flows(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(A.product_flows(fx.raw_flows(spark, sf)), "volume_raw")


@query(
    "allocate_by_area",
    sql(
        """
    SELECT pond AS POND_TRASE_ID, parish AS PARISH_TRASE_ID, round(area, 6) AS AREA_HA, y.YEAR AS YEAR,
           round(coalesce(x.total, 0) / 0.95 / (SELECT sum(area) FROM ponds) * area, 6) AS avg_produced_tons,
           round(coalesce(x.total, 0) / 0.95 / (SELECT sum(area) FROM ponds) * area, 6) AS avg_remaining_tons
    FROM ponds CROSS JOIN (SELECT CAST(unnest(range(1995, 2002)) AS VARCHAR) AS YEAR) y
    LEFT JOIN (SELECT YEAR, sum(volume_raw) AS total FROM exports GROUP BY 1) x ON x.YEAR = y.YEAR""",
        "ponds",
        "exports",
    ),
)
def allocate_by_area(spark: SparkSession, sf: str) -> DataFrame:
    made = A.allocate_by_area(fx.ponds(spark, sf), A.product_flows(fx.raw_flows(spark, sf)), fx.FLOW_YEARS)
    return _rounded(made, "AREA_HA", "avg_produced_tons", "avg_remaining_tons")


def _production(spark: SparkSession, sf: str) -> DataFrame:
    return A.production_per_parish(fx.ponds(spark, sf), A.product_flows(fx.raw_flows(spark, sf)), fx.FLOW_YEARS)


_PER_PARISH = sql(
    "SELECT PARISH_TRASE_ID, YEAR, round(avg_produced_tons, 6) AS avg_produced_tons, round(AREA_HA, 6) AS AREA_HA FROM parish_year", "parish_year"
)


@query("production_files", _PER_PARISH)
def production_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the file of ponds and one file of flows a year."""
    ponds, flows = new_scratch(spark, "ponds"), new_scratch(spark, "flows")
    fx.ponds(spark, sf).write.csv(ponds, sep=";", header=True)
    fx.raw_flows(spark, sf).repartition("YEAR").write.partitionBy("YEAR").csv(flows, sep=";", header=True)
    read = A.production_inputs(spark, ponds, {y: f"{flows}/YEAR={y}" for y in fx.FLOW_YEARS})
    made = A.production_per_parish(read[0], A.product_flows(read[1]), fx.FLOW_YEARS)
    return _rounded(made, "avg_produced_tons", "AREA_HA")


@query("production_per_parish", _PER_PARISH)
def production_per_parish(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_production(spark, sf), "avg_produced_tons", "AREA_HA")


@query(
    "area_per_parish",
    sql("SELECT PARISH_TRASE_ID, round(AREA_HA, 6) AS AREA_HA FROM parish_year WHERE YEAR = '2001'", "parish_year"),
)
def area_per_parish(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(A.area_per_parish(_production(spark, sf), fx.FLOW_YEARS[-1]), "AREA_HA")


@query(
    "allocation_check",
    sql(
        """
    SELECT coalesce(m.YEAR, x.YEAR) AS YEAR, round(coalesce(m.t, 0), 6) AS allocated, round(coalesce(x.t, 0), 6) AS exported,
           coalesce(m.t, 0) >= coalesce(x.t, 0) AS covered
    FROM (SELECT YEAR, sum(avg_produced_tons) AS t FROM parish_year GROUP BY 1) m
    FULL JOIN (SELECT YEAR, sum(volume_raw) AS t FROM exports GROUP BY 1) x ON x.YEAR = m.YEAR""",
        "parish_year",
    ),
)
def allocation_check(spark: SparkSession, sf: str) -> DataFrame:
    flows = A.product_flows(fx.raw_flows(spark, sf))
    return _rounded(A.allocation_check(_production(spark, sf), flows), "allocated", "exported")
