"""Dates, units, weights and row fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_months(start: Column, end: Column) -> Column:
    """Whole months from `start` to `end`, truncated toward zero."""
    return F.timestamp_diff("MONTH", start, end).cast("int")


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def path_weight(total: Column) -> Column:
    return F.lit(1.0) / (total + F.lit(1))


def to_tons(kilograms: Column) -> Column:
    return kilograms / F.lit(1000)


def significant(value: Column, digits: int = 9) -> Column:
    """Rounded to significant digits, so that small values stay apart however many rows share a total."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits - 1}e", value.cast("double")).cast("double"))


def path_length(nodes: Column) -> Column:
    return F.size(nodes) - 1


def on_path(node: Column, nodes: Column) -> Column:
    return F.array_contains(nodes, node)


def fingerprint(columns: Sequence[str | Column], mode: str = "md5") -> Column:
    """Row fingerprint.

    md5      128 bits over length-marked values; nulls differ from empty text
    xxhash64 64 bits, quicker; expect collisions from about a billion rows
    hash32   the 32-bit hash of the comma-joined values, nulls skipped
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    if mode == "hash32":
        return F.hash(F.concat_ws(",", *cols))
    marked = []
    for c in cols:
        text = c.cast("string")
        marked.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    if mode == "xxhash64":
        return F.xxhash64(*marked)
    if mode == "md5":
        return F.md5(F.concat_ws("|", *marked))
    raise ValueError(f"unknown fingerprint mode {mode!r}")


def freshness(source: Column, destination: Column) -> Column:
    """'newer', 'same' or 'inconsistent' (source older); no destination stamp means newer."""
    return (
        F.when(destination.isNull() | (source > destination), F.lit("newer"))
        .when(source == destination, F.lit("same"))
        .otherwise(F.lit("inconsistent"))
    )
