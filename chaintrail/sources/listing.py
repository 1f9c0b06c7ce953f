"""File listings as DataFrames; file contents are never read."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: suffix searched in the lower-cased file name.
CSV_MARK = ".csv"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below a folder."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length")
    )


def empty_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of the files below a folder that hold no byte, which a scan leaves out.

    Spark's own list of the files, which the driver of any scan holds, against those it would read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = lambda path: re.sub("^file:/+", "file:/", path)
    read = {plain(r["path"]) for r in files.select("path").toLocalIterator()}
    return sorted({plain(unquote(path)) for path in files.inputFiles()} - read)


def below(path: Column, root: str) -> Column:
    """Path without the root, whose scheme and authority a listing may have added."""
    plain = re.sub("^[A-Za-z0-9+.-]+:/+", "/", root).rstrip("/")
    return F.regexp_replace(path, "^.*?" + re.escape(plain) + "/+", "")


def list_csv_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """(path, length) of the CSV files below a folder; only a caller's limit leaves files out."""
    name = F.element_at(F.split("path", "/"), -1)
    files = list_files(spark, root).where(F.contains(F.lower(name), F.lit(CSV_MARK)))
    return files if max_bytes is None else files.where(F.col("length") <= max_bytes)


def dir_contents(spark: SparkSession, root: str) -> DataFrame:
    """(parent, name, is_file): direct children of the root ('') and of every folder below it that leads to a file."""
    parts = F.split(below(F.col("path"), root), "/")
    steps = list_files(spark, root).select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i"))
    return steps.select(
        F.array_join(F.slice("p", F.lit(1), F.col("i")), "/").alias("parent"),
        F.get(F.col("p"), F.col("i")).alias("name"),
        (F.col("i") == F.size("p") - 1).alias("is_file"),
    ).distinct()


def dataset_of(path: Column) -> Column:
    """Path of the dataset a part file belongs to (its folder), or of the file itself."""
    return F.regexp_replace(path, "/part-[^/]*$", "")
