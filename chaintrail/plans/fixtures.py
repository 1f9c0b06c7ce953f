"""Domain inputs as views over the given tables.

customer = farm, supplier = slaughterhouse, nation = city, region = state,
orders = permit, lineitem = animals of a permit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.operators.allocate import HS_CODES
from chaintrail.operators.groups import animal_groups, mark_compatible
from chaintrail.operators.paths import compatible_edges, project, target_year_edges, weighted
from chaintrail.operators.permits import FARM, SLAUGHTERHOUSE, permit_totals, sends_to

FLOW_YEARS = list(range(1995, 2002))
TARGET = 1  # slaughterhouse 0
TARGET_YEAR = 1998
SHED_YEARS = [1998, 1997]
SAMPLE_FARM = 42  # farm 21
SAMPLE_CITY = "NATION_3"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def permits(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    slaughter = F.col("o_orderstatus") == "F"
    to_slaughter = (F.col("o_orderkey") % _count(table(spark, sf, "supplier"))) * 2 + 1
    to_farm = ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % _count(table(spark, sf, "customer"))) * 2
    return orders.select(
        F.col("o_orderkey").alias("gta_id"),
        F.col("o_orderdate").cast("date").alias("gta_date"),
        F.year("o_orderdate").alias("year"),
        slaughter.alias("slaughter_gta"),
        (F.col("o_custkey") * 2).alias("origin_id"),
        F.when(slaughter, to_slaughter).otherwise(to_farm).alias("dest_id"),
        F.when(slaughter, SLAUGHTERHOUSE).otherwise(FARM).alias("dest_label"),
        F.lit(True).alias("dest_tax_known"),
    )


def animals(spark: SparkSession, sf: str) -> DataFrame:
    """Animal lines; the id is a digest of the whole line."""
    line = table(spark, sf, "lineitem")
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    size = F.col("p_size")
    ages = (
        F.when(size <= 12, "0 A 12 MESES")
        .when(size <= 24, "13 A 24 MESES")
        .when(size <= 36, "25 A 36 MESES")
        .otherwise("ACIMA DE 36 MESES")
    )
    sex = F.when(F.col("l_linestatus") == "F", "FEMEA").otherwise("MACHO")
    digest = F.md5(
        F.concat_ws(
            "|",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.col("l_quantity").cast("int"),
            F.round(F.col("l_extendedprice") * 100).cast("long"),
            F.col("l_shipdate").cast("date").cast("string"),
        )
    )
    return line.join(sizes, "l_partkey", "left").select(
        digest.alias("line_id"),
        F.col("l_orderkey").alias("gta_id"),
        F.concat(F.lit("BOVINO,"), sex, F.lit(","), ages).alias("description"),
        F.col("l_quantity").cast("int").alias("amount"),
    )


def animal_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Animal lines without description, for totals: no join with part."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("gta_id"), F.col("l_quantity").cast("int").alias("amount")
    )


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return sends_to(permit_totals(permits(spark, sf), animal_amounts(spark, sf)), FLOW_YEARS)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return animal_groups(permits(spark, sf), animals(spark, sf))


def farms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        (F.col("c_custkey") * 2).alias("id"), F.col("c_custkey").cast("string").alias("tax_number"), F.col("c_name").alias("name")
    )


def slaughterhouses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("id"),
        F.col("s_suppkey").cast("string").alias("tax_number"),
        F.col("s_name").alias("name"),
    )


def named_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return farms(spark, sf).withColumn("label", F.lit(FARM)).union(
        slaughterhouses(spark, sf).withColumn("label", F.lit(SLAUGHTERHOUSE))
    )


def cities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("geocode"), F.col("n_name").alias("name"))


def farm_places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        (F.col("c_custkey") * 2).alias("src"), F.col("c_nationkey").cast("string").alias("dst")
    )


def slaughter_places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("src"), F.col("s_nationkey").cast("string").alias("dst")
    )


def flow_graph(spark: SparkSession, sf: str) -> DataFrame:
    return project(flows(spark, sf), "total_sent")


def first_edges(spark: SparkSession, sf: str) -> DataFrame:
    return target_year_edges(flows(spark, sf), TARGET_YEAR)


def next_edges(spark: SparkSession, sf: str) -> DataFrame:
    return compatible_edges(mark_compatible(groups(spark, sf), TARGET_YEAR))


def path_graph(spark: SparkSession, sf: str) -> DataFrame:
    both = weighted(first_edges(spark, sf)).unionByName(weighted(next_edges(spark, sf)))
    return project(both, "path_weight")


def raw_permits(spark: SparkSession, sf: str) -> DataFrame:
    """Permit records in their published form, one per order, with two animal entries.

    City names differ between permits of one city; an unspecified priority leaves the
    slaughter flag unknown.
    """
    orders = table(spark, sf, "orders")
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "n_name", "r_name")
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    slaughter = F.col("o_orderstatus") == "F"

    def place(df: DataFrame, key: str, name: str, nation_key: str, side: str, is_slaughter: bool) -> DataFrame:
        return df.join(nation, F.col(nation_key) == F.col("n_nationkey")).select(
            F.col(key).alias(f"{side}_key"),
            F.lit(is_slaughter).alias(f"{side}_is_slaughter"),
            F.col(key).cast("string").alias(f"{side}_tax"),
            F.col(name).alias(f"{side}_name"),
            F.col(nation_key).cast("string").alias(f"{side}_geocode"),
            F.col("n_name").alias(f"{side}_nation"),
            F.col("r_name").alias(f"{side}_state"),
        )

    origin = place(customer, "c_custkey", "c_name", "c_nationkey", "o", False).drop("o_is_slaughter")
    dest = place(customer, "c_custkey", "c_name", "c_nationkey", "d", False).unionByName(
        place(supplier, "s_suppkey", "s_name", "s_nationkey", "d", True)
    )
    to_slaughter = F.col("o_orderkey") % _count(supplier)
    to_farm = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % _count(customer)
    sent = orders.withColumn("d_key", F.when(slaughter, to_slaughter).otherwise(to_farm)).withColumn("d_is_slaughter", slaughter)
    joined = sent.join(origin, F.col("o_custkey") == F.col("o_key")).join(dest, ["d_key", "d_is_slaughter"])
    entry = lambda d, a: F.struct(F.lit(d).alias("DESCRIPTION"), a.cast("int").alias("AMOUNT_SENT"))
    return joined.select(
        F.col("o_orderkey").cast("string").alias("ID"),
        F.col("o_orderstatus").alias("INFO_STATUS"),
        F.lit(None).cast("string").alias("TIMELINE_OBS"),
        F.lit(None).cast("string").alias("MISSING_INFO"),
        F.col("o_orderdate").cast("date").cast("string").alias("TRANSPORT_DATE"),
        F.year("o_orderdate").alias("TRANSPORT_YEAR"),
        F.lit("false").alias("NUM_ANIMALS_ASSUMED"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", slaughter).alias("SLAUGHTER_GTA"),
        F.array(
            entry("BOVINO,FEMEA,0 A 12 MESES", F.col("o_orderkey") % 40 + 1),
            entry("BOVINO,MACHO,ACIMA DE 36 MESES", F.col("o_custkey") % 25),
        ).alias("ANIMALS"),
        F.col("o_geocode").alias("ORIGIN_GEOCODE"),
        F.concat_ws("-", "o_nation", "o_orderstatus").alias("ORIGIN_CITY"),
        F.col("o_state").alias("ORIGIN_STATE"),
        F.concat(F.lit("F-"), "o_tax").alias("ORIGIN_CODE"),
        F.col("o_tax").alias("ORIGIN_TAX_NUMBER"),
        F.col("o_name").alias("ORIGIN_NAME"),
        F.col("d_geocode").alias("DESTINATION_GEOCODE"),
        F.concat_ws("-", "d_nation", "o_orderstatus").alias("DESTINATION_CITY"),
        F.col("d_state").alias("DESTINATION_STATE"),
        F.concat(F.when(slaughter, F.lit("S-")).otherwise(F.lit("F-")), "d_tax").alias("DESTINATION_CODE"),
        F.col("d_tax").alias("DESTINATION_TAX_NUMBER"),
        F.col("d_name").alias("DESTINATION_NAME"),
        F.col("o_orderpriority").alias("TRANSPOT"),
        F.col("o_orderstatus").alias("SPECIES_PURPOSE"),
        F.col("o_state").alias("GTA_SOURCE"),
        F.lit("BOVINO").alias("SPECIES"),
    )


def _more_copies(orders: DataFrame, digit: int, more: int) -> DataFrame:
    """Further copies of the orders whose key ends in `digit`."""
    rows = orders.where(F.col("o_orderkey") % 10 == digit)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(more)))).drop("copy")


def replica_source(spark: SparkSession, sf: str) -> DataFrame:
    """The orders, those ending in 3 twice."""
    orders = table(spark, sf, "orders")
    return orders.unionByName(_more_copies(orders, 3, 1))


def replica_dest(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of an earlier time: some missing, some at another price, some since removed, some three times."""
    orders = table(spark, sf, "orders")
    last = F.col("o_orderkey") % 10
    kept = orders.where(last != 0).withColumn(
        "o_totalprice", F.when(last == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    stale = orders.where(last == 2).withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000_000)
    return kept.unionByName(stale).unionByName(_more_copies(orders, 4, 2))


def ponds(spark: SparkSession, sf: str) -> DataFrame:
    lost = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") == 3)
    return table(spark, sf, "customer").select(
        F.concat(F.lit("POND-"), "c_custkey").alias("POND_TRASE_ID"),
        F.when(~lost, F.concat(F.lit("EC-"), "c_nationkey")).alias("PARISH_TRASE_ID"),
        (F.col("c_acctbal") + 1000).cast("string").alias("AREA_HA"),
    )


def raw_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Export declarations under their published column names, every value a string."""
    codes = F.array(*[F.lit(c) for c in [*HS_CODES, "030611", "160510"]])
    return table(spark, sf, "lineitem").select(
        F.year("l_shipdate").cast("string").alias("YEAR"),
        F.col("l_quantity").cast("int").cast("string").alias("TOTAL.Net.Weight..Kg."),
        F.get(codes, (F.col("l_partkey") % 9).cast("int")).alias("Harmonized.Code.Product.Spanish"),
    )


def _facility_code(key: str, shift: int = 0) -> Column:
    n = (F.col(key) + shift).cast("string")
    return (
        F.when(F.col(key) % 3 == 0, F.concat(F.lit("PPA-"), n)).when(F.col(key) % 3 == 1, F.concat(F.lit("PA-"), n)).otherwise(n)
    )


def facility_sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Five overlapping facility lists."""

    def listed(keep: Column, shift: int = 0) -> DataFrame:
        return table(spark, sf, "supplier").where(keep).select(
            _facility_code("s_suppkey", shift).alias("CODIGO"),
            F.col("s_name").alias("NOMBRE"),
            F.concat(F.lit("CALLE\r\n"), "s_nationkey").alias("DIRECCION_ESTABLECIMIENTO"),
            F.concat(F.lit("04-"), "s_suppkey").alias("TELEFONOS"),
            F.concat(F.lit("SR\n"), "s_name").alias("CONTACTO"),
            F.col("s_suppkey").alias("row_id"),
        )

    return {
        "df1": listed(F.col("s_nationkey") < 15),
        "df2": listed(F.col("s_nationkey") >= 10),
        "df3": listed(F.col("s_acctbal") < 0, 1_000_000_000),
        "df1_2018": listed(F.col("s_acctbal") >= 0),
        "df2_2018": listed(F.col("s_acctbal") < 0),
    }


def eu_list(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf, "supplier")
        .where(F.col("s_nationkey") % 2 == 0)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.when(F.col("s_acctbal") > 9000, F.concat(F.lit("X-"), "s_suppkey")).otherwise(F.col("s_suppkey").cast("string")).alias("CODE"),
            F.upper("s_name").alias("NAME"),
            F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("CITY"),
            F.col("r_name").alias("REGION"),
            F.lit("PP").alias("COMMENT"),
            F.lit("2018").alias("YEAR"),
        )
    )


def china_list(spark: SparkSession, sf: str) -> DataFrame:
    remarks = F.array(
        *[
            F.lit(r)
            for r in [
                "A", "A - FISHERY PRODUCTS", "FISHERY PRODUCTS", "AQUACULTURE PRODUCTS/FISHERY PRODUCTS",
                "AQUACULTURE PRODUCTS", "A - AQUACULTURE PRODUCTS", "OTHER",
            ]
        ]
    )
    return (
        table(spark, sf, "supplier")
        .where(F.col("s_nationkey") % 5 < 3)
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("APPROVALNO_CLEAN"),
            F.concat(F.lit("CN "), "s_name").alias("NAME"),
            F.lower("n_name").alias("City_County"),
            F.get(remarks, (F.col("s_suppkey") % 7).cast("int")).alias("Remark"),
        )
    )


def city_list(spark: SparkSession, sf: str) -> DataFrame:
    """Cities; the last nation's city and the first region's cantons are unknown."""
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat("n_name", F.lit("_P")).alias("PARISH"),
        F.when(F.col("r_regionkey") != 0, F.col("r_name")).alias("CANTON"),
        F.when(F.col("n_nationkey") != 24, F.col("n_name")).alias("CITY"),
        F.col("r_name").alias("REGION"),
    )


def parish_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where(
        F.col("n_nationkey") % 4 != 1
    ).select(
        F.concat("n_name", F.lit("_P")).alias("PARISH_NAME"),
        F.when(F.col("r_regionkey") != 0, F.col("r_name")).alias("CANTON_NAME"),
        F.concat(F.lit("EC-"), "n_nationkey").alias("TRASE_ID"),
    )
