"""Transport permits as a graph held in DataFrames.

Flat frames used below:

permits  gta_id, gta_date, year, slaughter_gta, origin_id, dest_id, dest_label,
         dest_tax_known, and for each side tax/name/geocode/city/state/code, plus
         transport, purpose, gta_source, species
animals  line_id, gta_id, description, amount
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaintrail.functions.text import key_text

FARM = "Farm"
SLAUGHTERHOUSE = "Slaughterhouse"


@dataclass
class Graph:
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)


def node_id(label: str, tax: Column, name: Column) -> Column:
    """Injective text id of a (label, tax number, name) node."""
    return F.concat(F.lit(label), F.lit(":"), F.length(tax).cast("string"), F.lit(":"), tax, F.lit(":"), name)


def normalise_permits(raw: DataFrame, *more: Column) -> DataFrame:
    """Raw permit records to the flat permits frame, with `more` columns of the records; missing keys become ''."""
    origin = (key_text(F.col("ORIGIN_TAX_NUMBER")), key_text(F.col("ORIGIN_NAME")))
    dest = (key_text(F.col("DESTINATION_TAX_NUMBER")), key_text(F.col("DESTINATION_NAME")))
    slaughter = F.col("SLAUGHTER_GTA")
    return raw.select(
        key_text(F.col("ID")).alias("gta_id"),
        F.col("TRANSPORT_DATE").cast("date").alias("gta_date"),
        F.col("TRANSPORT_YEAR").cast("int").alias("year"),
        slaughter.alias("slaughter_gta"),
        node_id(FARM, *origin).alias("origin_id"),
        origin[0].alias("origin_tax"),
        origin[1].alias("origin_name"),
        key_text(F.col("ORIGIN_GEOCODE")).alias("origin_geocode"),
        F.col("ORIGIN_CITY").alias("origin_city"),
        key_text(F.col("ORIGIN_STATE")).alias("origin_state"),
        key_text(F.col("ORIGIN_CODE")).alias("origin_code"),
        F.when(slaughter, node_id(SLAUGHTERHOUSE, *dest)).when(~slaughter, node_id(FARM, *dest)).alias("dest_id"),
        F.when(slaughter, SLAUGHTERHOUSE).when(~slaughter, FARM).alias("dest_label"),
        F.col("DESTINATION_TAX_NUMBER").isNotNull().alias("dest_tax_known"),
        dest[0].alias("dest_tax"),
        dest[1].alias("dest_name"),
        key_text(F.col("DESTINATION_GEOCODE")).alias("dest_geocode"),
        F.col("DESTINATION_CITY").alias("dest_city"),
        key_text(F.col("DESTINATION_STATE")).alias("dest_state"),
        key_text(F.col("DESTINATION_CODE")).alias("dest_code"),
        key_text(F.col("TRANSPOT")).alias("transport"),
        key_text(F.col("SPECIES_PURPOSE")).alias("purpose"),
        key_text(F.col("GTA_SOURCE")).alias("gta_source"),
        key_text(F.col("SPECIES")).alias("species"),
        F.col("INFO_STATUS").alias("info_status"),
        F.col("TIMELINE_OBS").alias("timeline_obs"),
        F.col("MISSING_INFO").alias("missing_info"),
        F.col("NUM_ANIMALS_ASSUMED").alias("num_animals_assumed"),
        *more,
    )


def unwind(df: DataFrame, array_col: str, alias: str = "item") -> DataFrame:
    """One row per array element; its position is kept, empty arrays vanish."""
    return df.select("*", F.posexplode(array_col).alias("position", alias)).drop(array_col)


def permit_animals(raw: DataFrame) -> DataFrame:
    """Raw permit records to the flat animals frame."""
    lines = unwind(raw.select(key_text(F.col("ID")).alias("gta_id"), "ANIMALS"), "ANIMALS", "animal")
    return lines.select(
        F.concat_ws("#", "gta_id", "position").alias("line_id"),
        "gta_id",
        key_text(F.col("animal.DESCRIPTION")).alias("description"),
        F.col("animal.AMOUNT_SENT").alias("amount"),
    )


def array_total(raw: DataFrame) -> DataFrame:
    """Animals per raw record, folded inside the row (no shuffle)."""
    total = F.aggregate(
        F.coalesce(F.col("ANIMALS"), F.array()),
        F.lit(0).cast("long"),
        lambda acc, x: acc + F.coalesce(x["AMOUNT_SENT"].cast("long"), F.lit(0)),
    )
    return raw.select(key_text(F.col("ID")).alias("gta_id"), total.alias("total_animals"))


def permit_totals(permits: DataFrame, animals: DataFrame) -> DataFrame:
    """Permits with total_animals; lines are summed before the join."""
    totals = animals.groupBy("gta_id").agg(F.sum(F.coalesce(F.col("amount"), F.lit(0))).alias("total_animals"))
    return permits.join(totals, "gta_id", "left").withColumn(
        "total_animals", F.coalesce(F.col("total_animals"), F.lit(0)).cast("long")
    )


def split_destinations(permits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to farms, to slaughterhouses); an unknown flag belongs to neither."""
    flag = F.col("slaughter_gta")
    return permits.where(~flag), permits.where(flag)


def sends_to(totalled: DataFrame, years: Iterable[int]) -> DataFrame:
    """Flow per (origin, destination): total and one column per year."""
    known = F.col("dest_tax_known")
    yearly = [
        F.sum(F.when((F.col("year") == y) & known, F.col("total_animals")).otherwise(0)).alias(f"total_{y}")
        for y in years
    ]
    return (
        totalled.where(F.col("dest_id").isNotNull())
        .groupBy(F.col("origin_id").alias("src"), F.col("dest_id").alias("dst"), "dest_label")
        .agg(F.sum("total_animals").alias("total_sent"), *yearly)
        .withColumnRenamed("dest_label", "dst_label")
    )


def city_nodes(permits: DataFrame, order: Column) -> DataFrame:
    """Cities by geocode; the name seen first in load order wins."""
    sides = permits.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("origin_geocode").alias("geocode"),
                    F.col("origin_city").alias("name"),
                    F.struct(order.alias("at"), F.lit(0).alias("side")).alias("seq"),
                ),
                F.struct(
                    F.col("dest_geocode").alias("geocode"),
                    F.col("dest_city").alias("name"),
                    F.struct(order.alias("at"), F.lit(1).alias("side")).alias("seq"),
                ),
            )
        ).alias("c")
    ).select("c.*")
    return sides.groupBy("geocode").agg(F.min_by("name", "seq").alias("name"))


def _distinct(df: DataFrame, *cols: Column) -> DataFrame:
    return df.select(*cols).distinct()


def farms(permits: DataFrame) -> DataFrame:
    to_farms, _ = split_destinations(permits)
    origin = permits.select(
        F.col("origin_id").alias("id"), F.col("origin_tax").alias("tax_number"), F.col("origin_name").alias("name")
    )
    dest = to_farms.select("dest_id", "dest_tax", "dest_name")
    return origin.union(dest).distinct()


def slaughterhouses(permits: DataFrame) -> DataFrame:
    _, to_slaughter = split_destinations(permits)
    return _distinct(
        to_slaughter, F.col("dest_id").alias("id"), F.col("dest_tax").alias("tax_number"), F.col("dest_name").alias("name")
    )


def location_edges(permits: DataFrame) -> dict[str, DataFrame]:
    """IS_LOCATED_IN, by kind of its two ends."""
    to_farms, to_slaughter = split_destinations(permits)
    city_state = permits.select(F.col("origin_geocode").alias("src"), F.col("origin_state").alias("dst")).union(
        permits.select("dest_geocode", "dest_state")
    )
    farm_city = permits.select(F.col("origin_id").alias("src"), F.col("origin_geocode").alias("dst")).union(
        to_farms.select("dest_id", "dest_geocode")
    )
    slaughter_city = to_slaughter.select(F.col("dest_id").alias("src"), F.col("dest_geocode").alias("dst"))
    return {
        "CITY_IS_LOCATED_IN": city_state.distinct(),
        "FARM_IS_LOCATED_IN": farm_city.distinct(),
        "SLAUGHTERHOUSE_IS_LOCATED_IN": slaughter_city.distinct(),
    }


def permit_edges(permits: DataFrame) -> dict[str, DataFrame]:
    """Edges of every permit to its attributes and its two ends."""
    gta = F.col("gta_id")
    to_farms, to_slaughter = split_destinations(permits)

    def pairs(src: Column, dst: Column, df: DataFrame = permits) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"))

    farm_codes = pairs(F.col("origin_id"), F.col("origin_code")).union(
        pairs(F.col("dest_id"), F.col("dest_code"), to_farms)
    )
    return {
        "IS_TRANSPORTED_BY": pairs(gta, F.col("transport")),
        "HAS_PURPOSE": pairs(gta, F.col("purpose")),
        "FROM_GTA_SOURCE": pairs(gta, F.col("gta_source")),
        "SPECIES_TRANSPORTED": pairs(gta, F.col("species")),
        "FARM_HAS_CODE": farm_codes.distinct(),
        "SLAUGHTERHOUSE_HAS_CODE": pairs(F.col("dest_id"), F.col("dest_code"), to_slaughter).distinct(),
        "IS_ORIGIN_OF_GTA": pairs(F.col("origin_id"), gta),
        "GTA_HAS_DESTINATION": pairs(gta, F.col("dest_id")).where(F.col("dst").isNotNull()),
    }


def build_graph(permits: DataFrame, animals: DataFrame, years: Iterable[int], order: Column) -> Graph:
    """All node and edge frames of the permit graph; each stays lazy until used."""
    totalled = permit_totals(permits, animals)
    codes = permits.select(F.explode(F.array("origin_code", "dest_code")).alias("code"))
    states = permits.select(F.explode(F.array("origin_state", "dest_state")).alias("name"))
    nodes = {
        FARM: farms(permits),
        SLAUGHTERHOUSE: slaughterhouses(permits),
        "City": city_nodes(permits, order),
        "State": states.distinct(),
        "GTA": totalled,
        "Transport": permits.select("transport").distinct(),
        "Purpose": permits.select("purpose").distinct(),
        "GTA_Source": permits.select("gta_source").distinct(),
        "Species": permits.select("species").distinct(),
        "Code": codes.distinct(),
        "Animal_Type": animals.select(F.col("description").alias("animal_type")).distinct(),
    }
    edges = {
        **location_edges(permits),
        **permit_edges(permits),
        "ANIMAL_TYPE_SENT": animals.select(F.col("gta_id").alias("src"), F.col("description").alias("dst"), "amount"),
        "SENDS_TO": sends_to(totalled, years),
    }
    return Graph(nodes, edges)


def _several(items: list[Column], animals: Column) -> Column:
    """One row for each struct in `items` that is not null, and for each element of `animals`."""
    return F.explode(F.concat(F.filter(F.array(*items), lambda x: x.isNotNull()), animals))


def _with_animals(raw: DataFrame) -> DataFrame:
    return normalise_permits(raw, F.coalesce(F.col("ANIMALS"), F.array()).alias("animals"))


def node_keys(raw: DataFrame) -> DataFrame:
    """(label, key) of every node in raw permit records: one scan, one `explode`, one distinct.

    A permit gives out all its keys at once; the few values of most labels combine before the shuffle.
    """

    def node(label: Column | str, key: Column) -> Column:
        label = F.lit(label) if isinstance(label, str) else label
        return F.struct(label.alias("label"), key.cast("string").alias("key"))

    c = F.col
    # fixed values: the labels
    keys = [
        node(FARM, c("origin_id")),
        F.when(c("dest_label").isNotNull(), node(c("dest_label"), c("dest_id"))),
        *(node("City", c(f"{side}_geocode")) for side in ("origin", "dest")),
        *(node("State", c(f"{side}_state")) for side in ("origin", "dest")),
        *(node("Code", c(f"{side}_code")) for side in ("origin", "dest")),
        node("GTA", c("gta_id")),
        node("Transport", c("transport")),
        node("Purpose", c("purpose")),
        node("GTA_Source", c("gta_source")),
        node("Species", c("species")),
    ]
    animals = F.transform("animals", lambda a: node("Animal_Type", key_text(a["DESCRIPTION"])))
    return _with_animals(raw).select(_several(keys, animals).alias("n")).select("n.*").distinct()


#: Edges that stand once however many permits name them; the others stand once per permit or animal line.
MERGED = [
    "CITY_IS_LOCATED_IN", "FARM_IS_LOCATED_IN", "SLAUGHTERHOUSE_IS_LOCATED_IN", "FARM_HAS_CODE", "SLAUGHTERHOUSE_HAS_CODE", "SENDS_TO",
]


def edge_pairs(raw: DataFrame) -> DataFrame:
    """(type, src, dst) of every edge in raw permit records: one scan, one `explode`, one count.

    The count tells how often an edge of a permit stands, which is once unless a record is repeated.
    """

    def edge(kind: Column | str, src: Column, dst: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("type"), src.cast("string").alias("src"), dst.cast("string").alias("dst"))

    c = F.col
    gta, origin, dest, known = c("gta_id"), c("origin_id"), c("dest_id"), c("dest_label").isNotNull()
    of_dest = lambda ending: F.concat(F.upper("dest_label"), F.lit(ending))
    pairs = [
        *(edge("CITY_IS_LOCATED_IN", c(f"{side}_geocode"), c(f"{side}_state")) for side in ("origin", "dest")),
        edge("FARM_IS_LOCATED_IN", origin, c("origin_geocode")),
        F.when(known, edge(of_dest("_IS_LOCATED_IN"), dest, c("dest_geocode"))),
        edge("FARM_HAS_CODE", origin, c("origin_code")),
        F.when(known, edge(of_dest("_HAS_CODE"), dest, c("dest_code"))),
        edge("IS_TRANSPORTED_BY", gta, c("transport")),
        edge("HAS_PURPOSE", gta, c("purpose")),
        edge("FROM_GTA_SOURCE", gta, c("gta_source")),
        edge("SPECIES_TRANSPORTED", gta, c("species")),
        edge("IS_ORIGIN_OF_GTA", origin, gta),
        F.when(known, edge("GTA_HAS_DESTINATION", gta, dest)),
        F.when(known, edge("SENDS_TO", origin, dest)),
    ]
    animals = F.transform("animals", lambda a: edge("ANIMAL_TYPE_SENT", gta, key_text(a["DESCRIPTION"])))
    rows = _with_animals(raw).select(_several(pairs, animals).alias("e")).select("e.*")
    times = F.when(F.col("type").isin(MERGED), 1).otherwise(F.col("count")).cast("int")
    counted = rows.groupBy("type", "src", "dst").count()
    return counted.select("type", "src", "dst", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")
