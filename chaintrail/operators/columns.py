"""Schema clean-up: column names, nested structs, path columns, keep-first de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaintrail.functions.headers import NON_ALPHANUMERIC_RUN, sanitise_names


def sanitise_columns(df: DataFrame, pattern: str = NON_ALPHANUMERIC_RUN) -> DataFrame:
    return df.toDF(*sanitise_names(df.columns, pattern))


def dashes_to_underscores(df: DataFrame) -> DataFrame:
    return sanitise_columns(df, "-")


def rename_strict(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns; a missing one is an error. Names may hold dots."""
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise KeyError(f"columns not found: {absent}")
    return df.withColumnsRenamed(names)


def _leaves(schema: T.StructType, above: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    plain = [(*above, f.name) for f in schema.fields if not isinstance(f.dataType, T.StructType)]
    nested = [f for f in schema.fields if isinstance(f.dataType, T.StructType)]
    for f in nested:
        plain += _leaves(f.dataType, (*above, f.name))
    return plain


def flatten(df: DataFrame) -> DataFrame:
    """Struct leaves as columns a_b_c; arrays stay as they are."""
    return df.select(
        *[F.col(".".join(f"`{part}`" for part in path)).alias("_".join(path)) for path in _leaves(df.schema)]
    )


def collect_columns(df: DataFrame, suffix: str = "s3_object", alias: str = "all_s3_records") -> DataFrame:
    """Array of the non-null values of all columns with the suffix, in column order."""
    found = [F.col(f"`{c}`") for c in df.columns if c.endswith(suffix)]
    values = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return df.withColumn(alias, values)


def keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per `subset` by `order`; nulls count as equal.

    A minimum of structs is reduced before the shuffle, so a third of the rows
    being copies of one does not gather them in one task, as a window would.
    """
    keyed = df.select(
        F.struct(*[F.col(c) for c in subset]).alias("_key"),
        F.struct(*order).alias("_order"),
        F.struct(*[F.col(c) for c in df.columns]).alias("_row"),
    )
    return keyed.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their count; empty when the key is unique."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
