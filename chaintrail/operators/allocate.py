"""Yearly production allocated to ponds and parishes by area."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.functions.measures import to_tons
from chaintrail.operators.columns import rename_strict
from chaintrail.sources.csv_files import read_strings

# Export share of production, product codes, input columns, years.
EXPORT_SHARE = 0.95
HS_CODES = ["030616", "030617", "030635", "030636", "030695", "160521", "160529"]
FLOW_COLUMNS = {"TOTAL.Net.Weight..Kg.": "volume_raw", "Harmonized.Code.Product.Spanish": "hs6"}
YEARS = list(range(2013, 2020))


def production_inputs(spark: SparkSession, ponds_path: str, flow_paths: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """(ponds, flows of all years with a YEAR column), every column a string."""
    flows = None
    for year, path in sorted(flow_paths.items()):
        df = read_strings(spark, path).withColumn("YEAR", F.lit(str(year)))
        flows = df if flows is None else flows.unionByName(df, allowMissingColumns=True)
    return read_strings(spark, ponds_path), flows


def product_flows(raw: DataFrame, codes: Iterable[str] = HS_CODES) -> DataFrame:
    """(YEAR, hs6, volume_raw in tons) of the wanted products."""
    return (
        rename_strict(raw, FLOW_COLUMNS)
        .where(F.col("hs6").isin(list(codes)))
        .select("YEAR", "hs6", to_tons(F.col("volume_raw").cast("double")).alias("volume_raw"))
    )


def _produced(area: Column, exports: Column, total_area: Column, share: float) -> Column:
    return ((exports / F.lit(share)) / total_area) * area


def _per_year(df: DataFrame, flows: DataFrame, years: Iterable[object]) -> DataFrame:
    """Every row once per year, with that year's exports (0 without any).

    The exports are one row per listed year at most, so they are always broadcast.
    """
    names = [str(y) for y in years]
    exports = flows.where(F.col("YEAR").isin(names)).groupBy("YEAR").agg(F.sum("volume_raw").alias("exports"))
    return (
        df.withColumn("YEAR", F.explode(F.array(*[F.lit(y) for y in names])))
        .join(F.broadcast(exports), "YEAR", "left")
        .withColumn("exports", F.coalesce(F.col("exports"), F.lit(0.0)))
    )


def total_area(ponds: DataFrame) -> Column:
    return ponds.agg(F.coalesce(F.sum(F.col("AREA_HA").cast("double")), F.lit(0.0))).scalar()


def allocate_by_area(ponds: DataFrame, flows: DataFrame, years: Iterable[object] = YEARS, share: float = EXPORT_SHARE) -> DataFrame:
    """Production of every pond and year in proportion to its area."""
    area = F.col("AREA_HA")
    produced = _produced(area, F.col("exports"), total_area(ponds), share)
    return _per_year(ponds.withColumn("AREA_HA", area.cast("double")), flows, years).select(
        "POND_TRASE_ID",
        "PARISH_TRASE_ID",
        "AREA_HA",
        produced.alias("avg_produced_tons"),
        produced.alias("avg_remaining_tons"),
        "YEAR",
    )


def production_per_parish(ponds: DataFrame, flows: DataFrame, years: Iterable[object] = YEARS, share: float = EXPORT_SHARE) -> DataFrame:
    """Area and production per (parish, year); ponds without a parish are left out.

    Production is linear in area, so ponds are summed to parishes before the years
    are attached: one aggregation of the ponds, however many years.
    """
    area = ponds.where(F.col("PARISH_TRASE_ID").isNotNull()).groupBy("PARISH_TRASE_ID").agg(
        F.coalesce(F.sum(F.col("AREA_HA").cast("double")), F.lit(0.0)).alias("AREA_HA")
    )
    produced = _produced(F.col("AREA_HA"), F.col("exports"), total_area(ponds), share)
    return _per_year(area, flows, years).select("PARISH_TRASE_ID", "YEAR", produced.alias("avg_produced_tons"), "AREA_HA")


def area_per_parish(production: DataFrame, year: object = YEARS[-1]) -> DataFrame:
    return production.where(F.col("YEAR") == str(year)).select("PARISH_TRASE_ID", "AREA_HA")


def allocation_check(production: DataFrame, flows: DataFrame) -> DataFrame:
    """Per year of either side, what was allocated and exported, and whether allocation covers it."""
    made = production.groupBy("YEAR").agg(F.sum("avg_produced_tons").alias("allocated"))
    sold = flows.groupBy("YEAR").agg(F.sum("volume_raw").alias("exported"))
    allocated, exported = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("allocated", "exported"))
    return made.join(sold, "YEAR", "full").select(
        "YEAR", allocated.alias("allocated"), exported.alias("exported"), (allocated >= exported).alias("covered")
    )
