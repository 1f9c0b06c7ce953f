"""Replication of a table by comparing row fingerprints, copies included."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.functions.measures import fingerprint, freshness
from chaintrail.session import discard, in_parallel, materialise

HASH, COPIES, VERSION = "row_hash", "copies", "version"
#: Copies of one row that one task writes out.
COPIES_PER_TASK = 100_000


def schema_info(df: DataFrame, exclude: Iterable[str] = ()) -> list[tuple[str, str]]:
    """Ordered (name, type) pairs without the excluded columns."""
    skip = set(exclude)
    return [pair for pair in df.dtypes if pair[0] not in skip]


def schema_drift(source: DataFrame, dest: DataFrame, exclude: Iterable[str] = (HASH,)) -> DataFrame:
    """One row per position whose name or type differs; no row means no drift. Order counts."""
    left, right = schema_info(source, exclude), schema_info(dest, exclude)
    rows = []
    for i in range(max(len(left), len(right))):
        a = left[i] if i < len(left) else (None, None)
        b = right[i] if i < len(right) else (None, None)
        if a != b:
            rows.append((i, *a, *b))
    return source.sparkSession.createDataFrame(
        rows, "position int, source_name string, source_type string, dest_name string, dest_type string"
    )


def with_hash(df: DataFrame, mode: str = "md5") -> DataFrame:
    return df.withColumn(HASH, fingerprint([c for c in df.columns if c != HASH], mode))


# --- differences of multisets


def _copies(df: DataFrame, sign: int) -> DataFrame:
    """(row_hash, copies) of each row, with `sign`; a frame that counts its copies keeps its counts."""
    count = F.col(COPIES) if COPIES in df.columns else F.lit(1)
    return df.select(HASH, (count.cast("long") * sign).alias(COPIES))


def changed_copies(source: DataFrame, dest: DataFrame) -> DataFrame:
    """(row_hash, copies): how often a row must be added to `dest` (above 0) or taken away (below 0).

    One sum over both sides: counts are added up before the shuffle, which carries
    fingerprints only, and a row that stands a million times is one row of it.
    """
    both = _copies(source, 1).unionByName(_copies(dest, -1))
    return both.groupBy(HASH).agg(F.sum(COPIES).alias(COPIES)).where(F.col(COPIES) != 0)


def rows_of(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """One row for each fingerprint in `changed`, with its copies.

    The change set is usually small, so its size on disk lets the planner broadcast it and
    leave the full rows where they are; a large one is shuffled.
    """
    some = rows.drop(COPIES).join(changed, HASH).dropDuplicates([HASH])
    return some.select(*[c for c in rows.columns if c != COPIES], COPIES)


def repeated(rows: DataFrame) -> DataFrame:
    """Every row as often as `copies` says. Rows with very many copies are dealt to several tasks."""
    most = rows.agg(F.max(COPIES)).first()[0] or 0
    kept = [c for c in rows.columns if c != COPIES]
    if most > COPIES_PER_TASK:
        parts = F.explode(F.sequence(F.lit(0), F.floor((F.col(COPIES) - 1) / COPIES_PER_TASK)))
        rows = rows.where(F.col(COPIES) > 0).withColumn("_part", parts)
        rows = rows.withColumn(COPIES, F.least(F.lit(COPIES_PER_TASK), F.col(COPIES) - F.col("_part") * COPIES_PER_TASK))
        rows = rows.repartition(HASH, "_part")
    copies = F.explode(F.array_repeat(F.lit(0), F.greatest(F.col(COPIES), F.lit(0)).cast("int")))
    return rows.select(*kept, copies.alias("_copy")).drop("_copy")


def changes(source: DataFrame, dest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserts, deletes) between fingerprinted frames, as multisets: each row as often as it must be added or removed.

    Each side is fingerprinted twice at most: to be compared, and to find its changed rows.
    """
    changed = materialise(changed_copies(source, dest), "changed-copies")
    added = changed.where(F.col(COPIES) > 0)
    gone = changed.where(F.col(COPIES) < 0).withColumn(COPIES, -F.col(COPIES))
    return (
        repeated(materialise(rows_of(source, added), "inserted-rows")).select(source.columns),
        repeated(materialise(rows_of(dest, gone), "deleted-rows")).select(dest.columns),
    )


def apply_changes(dest: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The next snapshot: as many copies of a row leave as were deleted, inserts join."""
    gone = deletes.groupBy(HASH).agg((-F.count("*")).alias(COPIES))
    return _alive(dest.withColumn(COPIES, F.lit(1).cast("long")), gone).unionByName(inserts).select(dest.columns)


def _alive(base: DataFrame, later: DataFrame) -> DataFrame:
    """`base` after the signed copies in `later`; rows it does not name are neither shuffled nor rewritten.

    `later` has the fingerprint and the copies, and may have the columns of new rows.
    """
    named = materialise(later.select(HASH).distinct(), "named-hashes")
    kept = base.join(named, HASH, "left_anti").select(base.columns)
    touched = base.join(named, HASH, "left_semi").select(base.columns)
    new = later.where(F.col(COPIES) > 0)
    full = touched if set(base.columns) - set(later.columns) else touched.unionByName(new.select(base.columns))
    left = _copies(touched, 1).unionByName(_copies(later, 1)).groupBy(HASH).agg(F.sum(COPIES).alias(COPIES))
    rows = materialise(rows_of(full, left.where(F.col(COPIES) > 0)), "touched-rows")
    # a row of the base stands once for each of its copies
    return kept.drop(COPIES).unionByName(repeated(rows))


# --- a log of versions


def as_of(log: DataFrame, version: int | None = None) -> DataFrame:
    """Rows alive at a version, by default the latest, of a log (row, row_hash, copies, version).

    The smallest version holds the whole table, later ones the signed copies of the rows that
    changed. Only what later versions name is compared; the rest of the first version is read as
    it was written.
    """
    upto = log if version is None else log.where(F.col(VERSION) <= version)
    first = log.agg(F.min(VERSION)).first()[0]
    columns = [c for c in log.columns if c != VERSION]
    base, later = (upto.where(c).select(columns) for c in (F.col(VERSION) == first, F.col(VERSION) > first))
    return _alive(base, later)


def source_freshness(source: DataFrame, field: str, stamp: str | None) -> DataFrame:
    """One row (source_time, state): the refresh field against the destination's stamp.

    The stamp is read leniently, with or without fractions of a second.
    """
    known = F.lit(stamp).cast("timestamp_ntz")
    return source.agg(F.max(F.col(field)).cast("timestamp_ntz").alias("source_time")).withColumn(
        "state", freshness(F.col("source_time"), known)
    )


@dataclass
class Outcome:
    table: str
    action: str
    inserted: int = 0
    deleted: int = 0
    version: int | None = None


STAMP = "source_time"


def _stamp(spark: SparkSession, table: str) -> str | None:
    row = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == STAMP).first()
    return row["value"] if row else None


def _last_version(spark: SparkSession, table: str) -> int:
    return spark.table(table).agg(F.max(VERSION)).first()[0]


def _begin(rows: DataFrame, table: str, version: int) -> int:
    """A log table that begins with all rows as `version`."""
    whole = rows.withColumn(COPIES, F.lit(1).cast("long")).withColumn(VERSION, F.lit(version))
    whole.write.format("parquet").mode("overwrite").partitionBy(VERSION).saveAsTable(table)
    return version


def _append(rows: DataFrame, changed: DataFrame, table: str) -> int:
    """One more version: rows to add with their columns, rows to remove by their fingerprint.

    A write that was cut off leaves files of a version the table does not know; the next one overwrites them.
    """
    spark = rows.sparkSession
    version = _last_version(spark, table) + 1
    added = rows_of(rows, changed.where(F.col(COPIES) > 0))
    gone = changed.where(F.col(COPIES) < 0)
    log = added.unionByName(gone, allowMissingColumns=True).select(*[c for c in spark.table(table).columns if c != VERSION])
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({VERSION} = {version}) SELECT * FROM {{log}}", log=log)
    return version


def _set_aside(spark: SparkSession, table: str, name: str) -> None:
    """Rename a log table; its versions are told where they are now, which not every catalogue does by itself."""
    spark.sql(f"ALTER TABLE {table} RENAME TO {name}")
    where = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
    for row in spark.sql(f"SHOW PARTITIONS {name}").collect():  # one row per version
        version = row["partition"].split("=")[1]
        spark.sql(f"ALTER TABLE {name} PARTITION ({VERSION} = {version}) SET LOCATION '{where}/{row['partition']}'")


def replicate(source: DataFrame, table: str, refresh_field: str | None = None, mode: str = "md5") -> Outcome:
    """Bring the log table `table` up to `source`: skip, begin anew, or write the difference.

    A new destination and changed columns begin a log; the one with the old columns is kept
    under a name with its last version. Stale rows are always looked for, also when both
    sides count the same. A table has one writer at a time.
    """
    spark, stamp = source.sparkSession, None
    known = spark.catalog.tableExists(table)
    if refresh_field:
        seen = source_freshness(source, refresh_field, _stamp(spark, table) if known else None).first()
        stamp = str(seen["source_time"])
        if seen["state"] == "same" and known:
            return Outcome(table, "up-to-date", version=_last_version(spark, table))
        source = source.drop(refresh_field)
    hashed = with_hash(source, mode)
    if not known:
        outcome = Outcome(table, "created", version=_begin(hashed, table, 0))
    elif schema_info(source, [HASH]) != schema_info(spark.table(table), [HASH, COPIES, VERSION]):
        last = _last_version(spark, table)
        _set_aside(spark, table, f"{table}_to_{last}")
        outcome = Outcome(table, "schema-changed", version=_begin(hashed, table, last + 1))
    else:
        changed = materialise(changed_copies(hashed, spark.table(table)), "changed-copies")
        more, less = changed.agg(F.sum(F.greatest(COPIES, F.lit(0))), F.sum(F.greatest(-F.col(COPIES), F.lit(0)))).first()
        if more is None:
            outcome = Outcome(table, "unchanged", version=_last_version(spark, table))
        else:
            outcome = Outcome(table, "changed", more, less, _append(hashed, changed, table))
        discard(changed)
    if stamp:
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{STAMP}'='{stamp}')")
    return outcome


def replicate_all(
    spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], refresh_field: str | None = None, at_once: int = 4
) -> list[Outcome]:
    """Replicate several tables, `at_once` of them at a time; one that fails is reported and does not stop the others."""
    done = in_parallel(spark, {t: lambda t=t: replicate(sources[t](), t, refresh_field) for t in sources}, at_once)
    return [r if isinstance(r, Outcome) else Outcome(t, f"failed: {r}") for t, r in done.items()]
