"""Registry of processing facilities, matched with import lists and enriched by city."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.functions.text import REMARK_TYPES, clean_breaks, map_values, simple_code
from chaintrail.operators.columns import keep_first, rename_strict
from chaintrail.operators.skew import broadcast_checked
from chaintrail.sources.csv_files import read_trimmed

# Column names of the published lists, code prefixes, flags, source.
SOURCE_COLUMNS = {
    "CODIGO": "CODE",
    "NOMBRE": "NAME",
    "DIRECCION_ESTABLECIMIENTO": "ADDRESS",
    "TELEFONOS": "TELEPHONE",
    "CONTACTO": "CONTACT",
}
TEXT_COLUMNS = ["NAME", "ADDRESS", "TELEPHONE", "CONTACT"]
COPY_KEY = ["CODE", "NAME", "ADDRESS", "CONTACT"]
CODE_PREFIXES = ["", "PPA-", "PA-"]
FULL_TYPE_PREFIX, FULL_TYPE, PLAIN_TYPE = "PPA-", "F Aq", "Aq"
TRUE, FALSE = "TRUE", "FALSE"
SOURCE = "www.acuaculturaypesca.gob.ec"
MATCHED_COLUMNS = [
    "CODE", "NAME", "ADDRESS", "TELEPHONE", "CONTACT", "SIMPLE_CODE", "CITY", "PARISH_TRASE_ID", "REGION", "CANTON",
    "EU_NAME_SYNONYM", "EU_TYPE", "EU_CERTIFIED", "CHINA_NAME_SYNONYM", "CHINA_CERTIFIED", "TYPE",
]
FINAL_KEY = [
    "CODE", "NAME", "SIMPLE_CODE", "CITY", "PARISH_TRASE_ID", "REGION", "CANTON", "EU_NAME_SYNONYM", "EU_TYPE",
    "EU_CERTIFIED", "CHINA_CERTIFIED", "TYPE",
]
INPUT_FILES = {
    "city_df": ",", "china_df": ",", "parish_df": ";", "eu_df": ";", "df1": ";", "df2": ";", "df3": ";",
    "df1_2018": ";", "df2_2018": ";",
}


def registry_inputs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The nine bronze inputs, every string stripped of white space; the facility lists know the place of each row."""
    return {name: read_trimmed(spark, paths[name], sep, position="row_id" if name.startswith("df") else "") for name, sep in INPUT_FILES.items()}


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Stack lists by column name; `source_rank` and `row_id` keep the reading order.

    `registry_inputs` gives row ids that do not depend on how files are split. A list without them
    is taken in the order of its partitions, which changes when its files are split otherwise.
    """
    out = None
    for rank, df in enumerate(sources):
        if "row_id" not in df.columns:
            here = (F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("row"))
            df = df.withColumn("row_id", F.struct(*here))
        df = df.withColumn("source_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def facility_list(sources: list[DataFrame], copies_of: int = 0) -> DataFrame:
    """One year's facilities under their English names, line breaks removed.

    Copies are dropped among the first `copies_of` sources, the first one stays.
    """
    stacked = rename_strict(union_sources(sources), SOURCE_COLUMNS)
    if copies_of:
        early = F.col("source_rank") < copies_of
        first = keep_first(stacked.where(early), COPY_KEY, ["source_rank", "row_id"])
        stacked = first.unionByName(stacked.where(~early))
    return stacked.withColumns({c: clean_breaks(F.col(c)) for c in TEXT_COLUMNS})


def city_parish(cities: DataFrame, parishes: DataFrame) -> DataFrame:
    """Cities with their parish id; a missing parish or canton matches a missing one."""
    named = parishes.select(
        F.col("PARISH_NAME").alias("_parish"), F.col("CANTON_NAME").alias("_canton"), F.col("TRASE_ID").alias("PARISH_TRASE_ID")
    )
    same = F.col("PARISH").eqNullSafe(F.col("_parish")) & F.col("CANTON").eqNullSafe(F.col("_canton"))
    return cities.join(named, same, "left").select("PARISH_TRASE_ID", "CITY", "REGION", "CANTON")


def unmatched_codes(codes: DataFrame, facilities: DataFrame) -> DataFrame:
    """Codes of an import list that no facility carries, bare or with a known prefix."""
    tried = codes.select(
        "CODE", F.explode(F.array(*[F.concat(F.lit(p), F.col("CODE").cast("string")) for p in CODE_PREFIXES])).alias("_try")
    )
    known = facilities.select(F.col("CODE").alias("_try")).distinct()
    matched = tried.join(known, "_try", "left_semi").select("CODE").distinct()
    return codes.join(matched, "CODE", "left_anti")


def match_facilities(facilities: DataFrame, eu: DataFrame, china: DataFrame, city_parishes: DataFrame) -> DataFrame:
    """Facilities with EU and China certification, city, parish, region and canton."""
    base = facilities.withColumn("SIMPLE_CODE", simple_code(F.col("CODE")))
    eu_side = eu.select(
        simple_code(F.col("CODE")).alias("_eu_simple"),
        F.col("CODE").alias("_eu_code"),
        F.col("NAME").alias("EU_NAME_SYNONYM"),
        F.col("CITY").alias("_eu_city"),
        F.col("REGION").alias("REGION"),
        F.col("COMMENT").alias("EU_TYPE"),
    )
    china_side = china.select(
        F.col("APPROVALNO_CLEAN").cast("int").alias("_china_code"),
        F.col("NAME").alias("CHINA_NAME_SYNONYM"),
        F.col("City_County").alias("_county"),
    )
    # facilities without a city share one key; a list of cities as small as usual is not shuffled for it
    city_side = broadcast_checked(city_parishes.select(F.col("CITY").alias("_city"), "PARISH_TRASE_ID", "CANTON"))
    flag = lambda c: F.when(F.col(c).isNull(), FALSE).otherwise(TRUE)
    return (
        base.join(eu_side, F.col("SIMPLE_CODE").eqNullSafe(F.col("_eu_simple")), "left")
        .join(china_side, F.col("SIMPLE_CODE").eqNullSafe(F.col("_china_code")), "left")
        .withColumns(
            {
                "EU_CERTIFIED": flag("_eu_code"),
                "CHINA_CERTIFIED": flag("_china_code"),
                "TYPE": F.when(F.col("CODE").startswith(FULL_TYPE_PREFIX), FULL_TYPE).otherwise(PLAIN_TYPE),
                "CITY": F.coalesce(F.col("_eu_city"), F.upper("_county")),
            }
        )
        .join(city_side, F.col("CITY").eqNullSafe(F.col("_city")), "left")
        .select(*MATCHED_COLUMNS, *[c for c in ("source_rank", "row_id") if c in facilities.columns])
    )


def map_remark(china: DataFrame) -> DataFrame:
    return china.withColumn("TYPE", map_values(F.col("Remark"), REMARK_TYPES))


def facility_registry(
    years: list[DataFrame], eu: DataFrame, china: DataFrame, cities: DataFrame, parishes: DataFrame
) -> DataFrame:
    """All years matched in one pass, first appearance kept, source named.

    `years` are frames of `facility_list`, oldest first.
    """
    stacked = None
    for rank, df in enumerate(years):
        df = df.withColumn("source_rank", F.col("source_rank") + F.lit(rank * 1000))
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    matched = match_facilities(stacked, eu, china, city_parish(cities, parishes))
    order = ["source_rank", "row_id", "CHINA_NAME_SYNONYM", "ADDRESS", "TELEPHONE", "CONTACT"]
    return keep_first(matched, FINAL_KEY, order).select(*MATCHED_COLUMNS).withColumn("SOURCE", F.lit(SOURCE))


def missing_canton(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count_if(F.col("CANTON").isNull()).alias("missing"), F.count(F.lit(1)).alias("total"))
