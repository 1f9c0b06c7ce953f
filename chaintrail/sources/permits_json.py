"""Permit records from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Field names and types of a permit record.
PERMIT_SCHEMA = """
    ID string, INFO_STATUS string, TIMELINE_OBS string, MISSING_INFO string,
    TRANSPORT_DATE string, TRANSPORT_YEAR int, NUM_ANIMALS_ASSUMED string, SLAUGHTER_GTA boolean,
    ANIMALS array<struct<DESCRIPTION: string, AMOUNT_SENT: int>>,
    ORIGIN_GEOCODE string, ORIGIN_CITY string, ORIGIN_STATE string, ORIGIN_CODE string,
    ORIGIN_TAX_NUMBER string, ORIGIN_NAME string,
    DESTINATION_GEOCODE string, DESTINATION_CITY string, DESTINATION_STATE string, DESTINATION_CODE string,
    DESTINATION_TAX_NUMBER string, DESTINATION_NAME string,
    TRANSPOT string, SPECIES_PURPOSE string, GTA_SOURCE string, SPECIES string
"""


def read_permits(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw permits with the declared schema; one record per line is split between tasks."""
    return spark.read.schema(PERMIT_SCHEMA).json(path, multiLine=multi_line)
