"""Animal groups and the inference of which group could come from which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaintrail.functions.measures import month_number, whole_months
from chaintrail.functions.text import OPEN_AGE_CAP, cap_open_age, lower_age_of, sex_of, upper_age_of
from chaintrail.operators.permits import FARM
from chaintrail.operators.skew import broadcast_checked
from chaintrail.session import materialise

ROWS_PER_CELL = 20_000
BIRTH_BIN_MONTHS = 12


def animal_groups(permits: DataFrame, animals: DataFrame) -> DataFrame:
    """One group per animal line of a permit that has a destination."""
    moved = permits.where(F.col("dest_id").isNotNull()).select(
        "gta_id", "gta_date", "year", "origin_id", "dest_id", "dest_label"
    )
    lower, upper = lower_age_of(F.col("description")), upper_age_of(F.col("description"))
    return animals.join(moved, "gta_id").select(
        F.col("line_id").alias("id"),
        "origin_id",
        "dest_id",
        "dest_label",
        "amount",
        sex_of(F.col("description")).alias("sex"),
        lower.alias("lower_age"),
        cap_open_age(lower, upper).alias("upper_age"),
        "description",
        F.col("gta_date").alias("transport_date"),
        F.col("year").alias("transport_year"),
        F.col("gta_id").alias("related_gta"),
    )


def could_come_from(later: DataFrame, earlier: DataFrame, rows_per_cell: int = ROWS_PER_CELL, hot: DataFrame | None | bool = False) -> DataFrame:
    """Pairs (ag1, ag2): ag1 left the farm ag2 had arrived at, and may hold its animals.

    The pair needs the same farm and sex, ag2 not after ag1, and age ranges that
    overlap once ag2 is aged by the whole months between the two dates. It is an
    equi-join on (farm, sex) with the rest as residual condition. A (farm, sex)
    with more than `rows_per_cell` groups on either side is cut further: by birth
    month, so that groups that cannot overlap do not meet, and into a grid of
    salts, so that no task compares more than rows_per_cell x rows_per_cell.

    `hot` is what `hot_cells` found for these groups or for more of them; by default it is looked for.
    """
    months = F.col("transport_date")
    one = later.where(F.col("sex").isNotNull() & F.col("lower_age").isNotNull() & F.col("upper_age").isNotNull()).select(
        F.col("id").alias("ag1"),
        F.col("origin_id").alias("farm_id"),
        F.col("sex"),
        F.col("dest_id").alias("ag1_dest_id"),
        F.col("transport_year").alias("ag1_year"),
        months.alias("date1"),
        F.col("amount").alias("amount1"),
        F.col("lower_age").alias("low1"),
        F.col("upper_age").alias("high1"),
    )
    two = earlier.where(
        (F.col("dest_label") == FARM)
        & F.col("sex").isNotNull()
        & F.col("lower_age").isNotNull()
        & F.col("upper_age").isNotNull()
    ).select(
        F.col("id").alias("ag2"),
        F.col("dest_id").alias("farm_id"),
        F.col("sex"),
        F.col("origin_id").alias("ag2_origin_id"),
        months.alias("date2"),
        F.col("amount").alias("amount2"),
        F.col("lower_age").alias("low2"),
        F.col("upper_age").alias("high2"),
    )
    keys, extra = ["farm_id", "sex"], F.lit(True)
    if hot is False:
        hot = _hot_cells(one, two, rows_per_cell)
    if hot is not None:
        one, two = _cut(one, two, hot)
        keys = keys + ["bin", "cell1", "cell2"]
        # a pair meets in every bin both touch; it counts in the first of them
        extra = F.col("bin") == F.when(F.col("is_hot"), F.greatest("first1", "first2")).otherwise(F.lit(0))
    aged = whole_months(F.col("date2"), F.col("date1"))
    low2, high2 = F.col("low2") + aged, F.col("high2") + aged
    return (
        one.join(two, keys)
        .where(
            extra
            & (F.col("ag1") != F.col("ag2"))
            & (F.col("date1") >= F.col("date2"))
            & (low2 <= F.col("high1"))
            & (high2 >= F.col("low1"))
        )
        .select(
            "ag1",
            "ag2",
            F.least("amount1", "amount2").alias("possible_animals"),
            (F.least(F.col("high1"), high2) - F.greatest(F.col("low1"), low2) + 1).alias("month_intersection"),
            "ag1_dest_id",
            "ag1_year",
            "farm_id",
            "ag2_origin_id",
        )
    )


def hot_cells(later: DataFrame, earlier: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame | None:
    """(farm, sex) keys of two sets of groups that are too big for one task, for several calls of `could_come_from`."""
    one = later.select(F.col("origin_id").alias("farm_id"), "sex")
    two = earlier.where(F.col("dest_label") == FARM).select(F.col("dest_id").alias("farm_id"), "sex")
    return _hot_cells(one, two, rows_per_cell)


def _hot_cells(one: DataFrame, two: DataFrame, rows_per_cell: int) -> DataFrame | None:
    """(farm, sex) keys that are too big for one task, with their number of cells per side."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("farm_id", "sex").agg(F.count(F.lit(1)).alias(name))

    cells = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(1)) / F.lit(rows_per_cell)).cast("int")
    both = counted(one, "n1").join(counted(two, "n2"), ["farm_id", "sex"])
    found = materialise(
        both.where((F.col("n1") > rows_per_cell) | (F.col("n2") > rows_per_cell)).select(
            "farm_id", "sex", cells("n1").alias("cells1"), cells("n2").alias("cells2")
        ),
        "hot-farms",
    )
    rows = found.count()
    return broadcast_checked(found, rows) if rows else None


def _cut(one: DataFrame, two: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    def bins(start: Column, end: Column) -> tuple[Column, Column]:
        width = F.lit(BIRTH_BIN_MONTHS)
        first = F.floor(F.least(start, end) / width).cast("int")
        last = F.floor(F.greatest(start, end) / width).cast("int")
        return first, last

    def side(df: DataFrame, date: str, low: str, high: str, slack: int, own: str, other: str, own_id: str, n: str) -> DataFrame:
        born = month_number(F.col(date))
        first, last = bins(born - F.col(high), born - F.col(low) + slack)
        is_hot = F.col("cells1").isNotNull()
        count = lambda name: F.coalesce(F.col(f"cells{name}"), F.lit(1))
        return (
            df.join(hot, ["farm_id", "sex"], "left")
            .withColumn("is_hot", is_hot)
            .withColumn(f"first{n}", first)
            .withColumn("bin", F.explode(F.when(is_hot, F.sequence(first, last)).otherwise(F.array(F.lit(0)))))
            .withColumn(own, F.pmod(F.xxhash64(own_id), count(n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), count("2" if n == "1" else "1") - 1)))
            .drop("cells1", "cells2")
        )

    cut1 = side(one, "date1", "low1", "high1", 0, "cell1", "cell2", "ag1", "1")
    cut2 = side(two, "date2", "low2", "high2", 1, "cell2", "cell1", "ag2", "2").drop("is_hot")
    return cut1, cut2


def mark_compatible(groups: DataFrame, year: int, max_age: int = OPEN_AGE_CAP) -> DataFrame:
    """Groups sent to a farm that can have reached slaughter in `year`.

    Either moved in that year, or younger than `max_age` months at its end; a
    later move counts negative months and passes as well.
    """
    age = whole_months(F.col("transport_date"), F.lit(f"{year}-12-31").cast("date")) + F.col("lower_age")
    fits = (F.col("transport_year") == year) | (age < max_age)
    return groups.where(F.col("dest_label") == FARM).withColumn("possible_source", F.coalesce(fits, F.lit(False)))
