"""Direct and indirect suppliers of a slaughterhouse."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chaintrail.operators.groups import could_come_from, hot_cells
from chaintrail.operators.permits import FARM, SLAUGHTERHOUSE
from chaintrail.operators.skew import broadcast_checked
from chaintrail.session import discard, materialise

DEGREES = ("first_degree", "second_degree", "third_degree")


def top_receivers(flows: DataFrame, places: DataFrame, cities: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """Slaughterhouses that received most; one row per (city, name, tax number).

    Flows are summed per slaughterhouse before names and cities are attached.
    """
    received = flows.where(F.col("dst_label") == SLAUGHTERHOUSE).groupBy("dst").agg(F.sum("total_sent").alias("received"))
    return (
        received.join(names, received["dst"] == names["id"])
        .join(places.select(F.col("src").alias("place_of"), F.col("dst").alias("geocode")), F.col("dst") == F.col("place_of"))
        .join(cities.select("geocode", F.col("name").alias("city")), "geocode")
        .groupBy("city", F.col("name").alias("slaughterhouse_name"), F.col("tax_number").alias("slaughterhouse_taxnumber"))
        .agg(F.sum("received").alias("animals_received"))
        .orderBy(F.desc("animals_received"), "slaughterhouse_taxnumber", "city")
        .limit(k)
    )


def first_degree_farms(flows: DataFrame, target: object) -> DataFrame:
    return flows.where(F.col("dst") == F.lit(target)).agg(F.countDistinct("src").alias("first_degree_farms"))


def farm_inflow(groups: DataFrame, farm: object) -> DataFrame:
    """Animals, groups and farms that sent to one farm."""
    return groups.where((F.col("dest_id") == F.lit(farm)) & (F.col("dest_label") == FARM)).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("animals_sent"),
        F.count(F.lit(1)).alias("animal_groups"),
        F.countDistinct("origin_id").alias("farms"),
    )


def second_degree_groups(
    groups: DataFrame, flows: DataFrame, target: object, via: Column, limit: int | None = None
) -> DataFrame:
    """Groups ag2 -> farm -> ag1 -> target whose farm of origin does not send to the target itself.

    `via` is a condition on the farm in between, over its column farm_id. With a
    limit the first pairs by (ag1, ag2) are wanted; each of them takes one of the
    first `limit` groups of its farm on either side, so no more than those meet.
    """
    ag1 = groups.where((F.col("dest_id") == F.lit(target)) & (F.col("dest_label") == SLAUGHTERHOUSE)).select(
        F.col("id").alias("ag1"), F.col("origin_id").alias("farm_id")
    )
    ag2 = groups.where(F.col("dest_label") == FARM).select(
        F.col("id").alias("ag2"), F.col("dest_id").alias("farm_id"), F.col("origin_id").alias("second_farm_id")
    )
    direct = flows.where(F.col("dst") == F.lit(target)).select(F.col("src").alias("second_farm_id")).distinct()
    ag1, ag2 = ag1.where(via), ag2.where(via).join(direct, "second_farm_id", "left_anti")
    if limit is not None:
        ag1, ag2 = _first_of_farm(ag1, "ag1", limit), _first_of_farm(ag2, "ag2", limit)
    # ag1 goes to a slaughterhouse and ag2 to a farm: the two never coincide
    paths = ag1.join(ag2, "farm_id").select("ag1", "farm_id", "ag2", "second_farm_id")
    return paths if limit is None else paths.orderBy("ag1", "ag2").limit(limit)


def _first_of_farm(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k least keys per farm; the engine keeps k per task before it shuffles."""
    place = F.row_number().over(Window.partitionBy("farm_id").orderBy(key))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def chain_permits(permits: DataFrame, target: object, years: Iterable[int], hops: int = 2) -> DataFrame:
    """Permits whose groups may lie on a chain of `hops` farms to the target, written.

    These are the permits to the target in the years, and those to a farm that a permit of the hop before
    comes from; whether a group could come from another is not asked here. `supplier_degrees` finds the same
    with their groups as with all. A hop reads the permits once and keeps one row per farm.
    """
    arriving = permits.where(
        (F.col("dest_id") == F.lit(target)) & (F.col("dest_label") == SLAUGHTERHOUSE) & F.col("year").isin(list(years))
    )
    to_farms = permits.where(F.col("dest_label") == FARM)
    arriving = materialise(arriving, "arriving")
    kept, spent = arriving, []
    for _ in range(hops):
        farms = kept.select(F.col("origin_id").alias("dest_id")).distinct()
        farms = materialise(farms, "chain-farms")
        sent = materialise(to_farms.join(broadcast_checked(farms), "dest_id", "left_semi").select(*permits.columns), "chain-permits")
        kept = arriving.unionByName(sent)
        discard(farms, *spent)
        spent = [sent]
    out = materialise(kept, "chain")
    discard(arriving, *spent)
    return out


def supplier_degrees(groups: DataFrame, target: object, years: Iterable[int], degrees: Iterable[str] = DEGREES) -> DataFrame:
    """(farm_id, year, degree, animals) of one slaughterhouse, all years in one pass.

    first   what the farm sent itself
    second  per arriving group the best link to a group of the farm, summed
    third   per arriving group and farm the lesser of the best first and best
            second link of its chains, summed

    Only groups on a chain to the target are inferred, and only for the degrees asked for; the
    second hop is reduced to one row per (group, farm) before it meets the first. Hot farms are
    measured once, on all groups, and cut in both hops.
    """
    degrees = [d for d in DEGREES if d in set(degrees)]
    arriving = groups.where(
        (F.col("dest_id") == F.lit(target))
        & (F.col("dest_label") == SLAUGHTERHOUSE)
        & F.col("transport_year").isin(list(years))
    )
    year, parts = F.col("ag1_year").alias("year"), {}
    if "first_degree" in degrees:
        parts["first_degree"] = arriving.groupBy(F.col("origin_id").alias("farm_id"), F.col("transport_year").alias("year")).agg(
            F.sum("amount").alias("animals")
        )
    if degrees != ["first_degree"]:
        hot = hot_cells(groups, groups)
        hop1 = could_come_from(arriving, groups, hot=hot).select("ag1", "ag1_year", "ag2", "ag2_origin_id", "possible_animals")
    if "third_degree" in degrees:
        hop1 = materialise(hop1, "hop1")  # read for the second hop, and for both degrees
        linked = hop1.select(F.col("ag2").alias("id")).distinct()
        hop2 = (
            could_come_from(groups.join(linked, "id", "left_semi"), groups, hot=hot)
            .groupBy(F.col("ag1").alias("ag2"), F.col("ag2_origin_id").alias("farm_id"))
            .agg(F.max("possible_animals").alias("best2"))
        )
        parts["third_degree"] = (
            hop1.select("ag1", "ag1_year", "ag2", "possible_animals")
            .join(hop2, "ag2")
            .groupBy("ag1", year, "farm_id")
            .agg(F.least(F.max("possible_animals"), F.max("best2")).alias("best"))
            .groupBy("farm_id", "year")
            .agg(F.sum("best").alias("animals"))
        )
    if "second_degree" in degrees:
        parts["second_degree"] = (
            hop1.groupBy("ag1", year, F.col("ag2_origin_id").alias("farm_id"))
            .agg(F.max("possible_animals").alias("best"))
            .groupBy("farm_id", "year")
            .agg(F.sum("best").alias("animals"))
        )
    stacked = [
        parts[name].select("farm_id", "year", F.lit(name).alias("degree"), F.col("animals").cast("long").alias("animals")) for name in degrees
    ]
    return reduce(DataFrame.unionByName, stacked)


def one_degree(degrees: DataFrame, degree: str) -> DataFrame:
    return degrees.where(F.col("degree") == degree).select("farm_id", "year", F.col("animals").alias(degree))


def supply_shed(degrees: DataFrame, farms: DataFrame, years: list[int], places: DataFrame | None = None) -> DataFrame:
    """One row per farm that has any degree, a column per degree and year.

    Degrees arrive as rows, so one aggregation replaces a chain of outer joins.
    The first degree of the first year is 0 where absent, the others stay null.
    `places` (farm_id, city_name, city_geocode) fans out farms of several cities and
    drops farms of none.
    """
    cols = [f"{degree}_{y}" for y in years for degree in DEGREES]
    picked = [
        F.sum(F.when((F.col("year") == y) & (F.col("degree") == degree), F.col("animals"))).alias(f"{degree}_{y}")
        for y in years
        for degree in DEGREES
    ]
    wide = (
        degrees.groupBy("farm_id")
        .agg(*picked)
        .where(has_any_degree(*[F.col(c) for c in cols]))
        .withColumn(cols[0], F.coalesce(F.col(cols[0]), F.lit(0)))
    )
    named = wide.join(
        farms.select(F.col("id").alias("farm_id"), F.col("name").alias("Farm_name"), F.col("tax_number").alias("Tax_number")),
        "farm_id",
    )
    names = ["Farm_name", "Tax_number"]
    if places is not None:
        named = named.join(places, "farm_id").withColumnsRenamed({"city_name": "City_name", "city_geocode": "City_geocode"})
        names = ["City_name", "City_geocode", *names]
    return named.select(*names, *cols).orderBy(F.desc(cols[0]), *names[::-1])


def has_any_degree(*degrees: Column) -> Column:
    return F.coalesce(*degrees).isNotNull()
