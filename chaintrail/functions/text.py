"""Scalar text rules: whitespace, facility codes, animal descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age in months given to open-ended descriptions, and the
# remark-to-type lookup of the import-country list.
OPEN_AGE_CAP = 42
REMARK_TYPES = {
    "A": "Aq",
    "A - FISHERY PRODUCTS": "F Aq",
    "FISHERY PRODUCTS": "F",
    "AQUACULTURE PRODUCTS/FISHERY PRODUCTS": "F Aq",
    "AQUACULTURE PRODUCTS": "Aq",
    "A - AQUACULTURE PRODUCTS": "Aq",
}


def strip_space(c: Column) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_breaks(c: Column) -> Column:
    return F.translate(c, "\r\n", "  ")


def simple_code(code: Column) -> Column:
    """Number after the last dash; junk raises in ANSI mode."""
    return F.element_at(F.split(code, "-"), -1).cast("int")


def map_values(c: Column, mapping: dict[str, str]) -> Column:
    """Dictionary lookup; a value outside the dictionary becomes null."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*pairs)[c]


def sex_of(description: Column) -> Column:
    """Text between the first two commas."""
    return F.nullif(F.regexp_extract(description, ",([^,]+),", 1), F.lit(""))


def lower_age_of(description: Column) -> Column:
    """First run of digits."""
    return F.regexp_extract(description, r"^[^\d]*(\d+)", 1).try_cast("int")


def upper_age_of(description: Column) -> Column:
    """Last run of digits."""
    return F.regexp_extract(description, r"(\d+)[^\d]*$", 1).try_cast("int")


def cap_open_age(lower: Column, upper: Column, cap: int = OPEN_AGE_CAP) -> Column:
    """An open-ended range names one number only; its upper end becomes the cap."""
    return F.when(lower == upper, F.lit(cap)).otherwise(upper)


def key_text(c: Column) -> Column:
    """Merge key: a missing value is the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))
