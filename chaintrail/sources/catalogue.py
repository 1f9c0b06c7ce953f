"""Repository catalogues: YAML records, nested and flat tables, listed CSV files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.operators.columns import collect_columns, dashes_to_underscores, flatten
from chaintrail.session import new_scratch

# First line of a catalogue, start of a record, suffix of a CSV path.
CATALOGUE_HEAD = "repositories:"
RECORD_START = "\n- "
CSV_END = ".csv"


def _to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading a YAML catalogue needs PyYAML on the executors") from missing

    def record(text: str) -> str:
        return json.dumps(yaml.safe_load("- " + text)[0], default=str)

    for batch in batches:
        yield pd.DataFrame({"value": batch["value"].map(record)})


def yaml_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON text per top-level list item of the YAML files.

    Items are the rows of the scan, so a big catalogue is split between tasks and a
    Python worker parses one record at a time.
    """
    rows = spark.read.text(path, lineSep=RECORD_START)
    # what stands before the first record: a head line, comments, a document mark
    preamble = F.regexp_replace("value", f"(?m)^\\s*(#.*|---|{CATALOGUE_HEAD})\\s*$", "")
    rows = rows.where(F.length(F.trim(F.translate(preamble, "\r\n", "  "))) > 0)
    # the first record of a file without a head line still carries its dash
    return rows.select(F.regexp_replace("value", "^- ", "").alias("value")).mapInPandas(_to_json, "value string")


def read_yaml(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Nested records; keys vary by record, so without a schema the types are inferred."""
    texts = yaml_records(spark, path)
    if schema is not None:
        return texts.select(F.from_json("value", schema).alias("r")).select("r.*")
    lines = new_scratch(spark, "catalogue")
    texts.write.text(lines)
    return read_nested_json(spark, lines, multi_line=False)


def read_nested_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.option("mode", "PERMISSIVE").option("multiLine", multi_line).json(path)


def silver_catalogue(nested: DataFrame) -> DataFrame:
    """Flat catalogue with all_s3_records, the array of every path of the record."""
    return collect_columns(dashes_to_underscores(flatten(nested)))


def build_silver(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    nested = read_yaml(spark, path, schema)
    return nested, silver_catalogue(nested)


def catalogue_csvs(silver: DataFrame, namespace: str | None = None, db: str = "", paths: str = "all_s3_records") -> DataFrame:
    """Distinct CSV paths of a namespace, optionally of one database (second folder)."""
    chosen = silver if namespace is None else silver.where(F.col("namespace") == namespace)
    listed = chosen.select(F.explode(paths).alias("path")).where(F.endswith("path", F.lit(CSV_END)))
    if db:
        listed = listed.where(F.get(F.split("path", "/"), F.lit(1)) == db)
    return listed.distinct()


def existing(listed: DataFrame, files: DataFrame, key: Column | str = "path") -> tuple[DataFrame, DataFrame]:
    """(paths that exist, paths that are missing) against a listing."""
    there = files.select(F.col(key) if isinstance(key, str) else key).toDF("path").distinct()
    return listed.join(there, "path", "left_semi"), listed.join(there, "path", "left_anti")
