"""Options and frames of JDBC reads. Nothing here opens a connection by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fetch size and default number of connections.
FETCH_SIZE = 10_000
CONNECTIONS = 8


def query_options(url: str, query: str, user: str = "", password: str = "", driver: str = "") -> dict[str, str]:
    """Options that let the database answer a query."""
    options = {"url": url, "query": query}
    options.update({k: v for k, v in {"user": user, "password": password, "driver": driver}.items() if v})
    return options


def partitioned_options(
    base: dict[str, str], column: str, lower: object, upper: object, partitions: int = CONNECTIONS, fetch_size: int = FETCH_SIZE
) -> dict[str, str]:
    """Options that split a read into strides of a column over several connections.

    The source reads a table in strides, not a query, so a query becomes one by a name.
    """
    whole = dict(base)
    if "query" in whole:
        whole["dbtable"] = f"({whole.pop('query')}) strided"
    return {
        **whole,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def read_query(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def schema_probe(spark: SparkSession, base: dict[str, str], table: str) -> DataFrame:
    """No rows, only the schema of a table."""
    return read_query(spark, {**{k: v for k, v in base.items() if k != "dbtable"}, "query": f"SELECT * FROM {table} WHERE 1 = 0"})


def column_bounds(df: DataFrame, column: str) -> DataFrame:
    """(lower_bound, upper_bound); pushed into the database for a JDBC frame."""
    return df.agg(F.min(column).alias("lower_bound"), F.max(column).alias("upper_bound"))


def hash_predicates(expression: str, parts: int) -> list[str]:
    """One predicate per connection for a skewed or textual key; nulls go to the first.

    `expression` is an integer expression of the database, such as hashtext(key).
    """
    return [f"MOD(ABS({expression}), {parts}) = {i}" + (f" OR ({expression}) IS NULL" if i == 0 else "") for i in range(parts)]


def read_hash_split(spark: SparkSession, url: str, table: str, expression: str, parts: int, properties: dict[str, str]) -> DataFrame:
    return spark.read.jdbc(url, table, predicates=hash_predicates(expression, parts), properties=properties)
