"""Tables and exports: save, describe, stamp, load folders of CSV files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chaintrail.functions.headers import bronze_name
from chaintrail.operators.columns import sanitise_columns
from chaintrail.session import discard, in_parallel, materialise
from chaintrail.sources.csv_files import CORRUPT, read_csv, read_header, read_repaired
from chaintrail.sources.listing import CSV_MARK, below, dataset_of, empty_files, list_csv_files, list_files


def create_database(spark: SparkSession, db: str, location: str | None = None, comment: str = "") -> None:
    at = f" LOCATION '{_quoted(location)}'" if location else ""
    note = comment or (f"Tables of {db}, stored below {location}" if location else f"Tables of {db}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}` COMMENT '{_quoted(note)}'{at}")


def _quoted(text: str) -> str:
    return str(text).replace("\\", "\\\\").replace("'", "\\'")


def save_table(df: DataFrame, name: str, mode: str = "overwrite", source_format: str = "parquet") -> None:
    """Overwrite also replaces the columns."""
    df.write.format(source_format).mode(mode).saveAsTable(name)


def describe_table(spark: SparkSession, name: str, comment: str, properties: dict[str, str]) -> None:
    spark.sql(f"COMMENT ON TABLE {name} IS '{_quoted(comment)}'")
    if properties:
        pairs = ", ".join(f"'{_quoted(k)}'='{_quoted(v)}'" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs})")


def table_properties(spark: SparkSession, name: str, keys: Iterable[str]) -> DataFrame:
    return spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key").isin(list(keys)))


@dataclass
class Load:
    """What became of one file: loaded, empty, or failed for a reason."""

    path: str
    table: str
    state: str
    rows_written: int = 0
    bad_rows: int = 0
    reason: str = ""


def load_file(
    spark: SparkSession, path: str, database: str, table: str, mode: str = "overwrite", note: str = "", schema: str | None = None
) -> Load:
    """One CSV file or dataset into a bronze table; an empty file makes none.

    Types come from all of its rows unless a schema is given. The file is split unless a quoted
    field may span lines. Good rows are counted while they are written. Rows that do not fit go,
    as text, to a second table with the suffix _bad_records, by a second read that only such rows
    cause; an overwrite without them removes the one of an earlier load.
    """
    name, rejects = f"`{database}`.`{table}`", f"`{database}`.`{table}_bad_records`"
    if read_header(spark, path) is None:
        return Load(path, name, "empty")
    df, delimiter = read_repaired(spark, path, schema, corrupt=CORRUPT, columnPruning=False)
    counts, fits = Observation(), F.col(CORRUPT).isNull()
    counted = df.observe(counts, F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("bad"))
    save_table(sanitise_columns(counted.where(fits).drop(CORRUPT)), name, mode)
    rows, bad = counts.get["rows"], counts.get["bad"]
    # fixed values: the keys of the properties
    properties = {"source_csv_file": path, "write_mode": mode, "source_delimiter": delimiter}
    if bad:
        properties["bad_records"] = f"{table}_bad_records"
        parsed = materialise(df.where(~fits), "bad-records")
        save_table(parsed.select(F.col(CORRUPT).alias("record")), rejects, mode)
        discard(parsed)
    elif mode == "overwrite":
        spark.sql(f"DROP TABLE IF EXISTS {rejects}")
    describe_table(spark, name, f"Loaded from the CSV file {path}" + (f"; {note}" if note else ""), properties)
    return Load(path, name, "loaded", rows - bad, bad)


def load_csv(spark: SparkSession, path: str, database: str, mode: str = "overwrite", table: str = "", note: str = "") -> str:
    """`load_file` of one file that must hold a table; returns the table's name."""
    if not table:
        file = path.rstrip("/").rsplit("/", 1)[-1]
        table = spark.range(1).select(bronze_name(F.lit(file))).first()[0]
    done = load_file(spark, path, database, table, mode, note)
    if done.state == "empty":
        raise ValueError(f"{path} is empty")
    return done.table


def named_files(files: DataFrame, root: str) -> DataFrame:
    """`files` with a column `table`, no two alike: from the file's name, or where that is taken from its path below the root."""
    short = bronze_name(F.element_at(F.split("path", "/"), -1))
    long = bronze_name(F.regexp_replace(below(F.col("path"), root), "/", "_"))
    named = files.select("*", short.alias("_short"), long.alias("_long"))
    shared = named.groupBy("_short").count().where("count > 1").select("_short").withColumn("_shared", F.lit(True))
    named = named.join(shared, "_short", "left").withColumn("_own", F.col("_shared").isNull())
    named = named.withColumn("_name", F.when(F.col("_own"), F.col("_short")).otherwise(F.col("_long")))
    # a long name may meet another name still; all but the first of them carry a digest of their path
    first = named.groupBy("_name").agg(F.max(F.struct(F.col("_own"), F.col("path"))).alias("_first"))
    tag = F.concat(F.col("_name"), F.lit("_"), F.substring(F.md5("path"), 1, 8))
    named = named.join(first, "_name").withColumn("table", F.when(F.col("_first.path") == F.col("path"), F.col("_name")).otherwise(tag))
    return named.select(*files.columns, "table")


def _load_each(spark: SparkSession, wanted: list[tuple[str, str, str]], at_once: int) -> list[Load]:
    """Load (path, database, table) side by side; a file that fails is reported and does not stop the others."""
    for database in sorted({d for _, d, _ in wanted}):
        create_database(spark, database)
    tasks = {path: lambda p=path, d=database, t=table: load_file(spark, p, d, t) for path, database, table in wanted}
    done = in_parallel(spark, tasks, at_once)
    return [
        done[path] if isinstance(done[path], Load) else Load(path, f"`{database}`.`{table}`", "failed", reason=str(done[path]).split("\n")[0])
        for path, database, table in wanted
    ]


def load_csv_folder(spark: SparkSession, root: str, database: str, max_bytes: int | None = None, at_once: int = 4) -> list[Load]:
    """Every CSV file below a folder into its own bronze table, with one outcome per file.

    Only the list of files comes to the driver, one entry per table to create.
    """
    files = named_files(list_csv_files(spark, root, max_bytes), root)
    loads = _load_each(spark, [(f["path"], database, f["table"]) for f in files.orderBy("path").toLocalIterator()], at_once)
    return loads + [Load(path, "", "empty") for path in empty_files(spark, root) if CSV_MARK in path.rsplit("/", 1)[-1].lower()]


def load_catalogue_csvs(spark: SparkSession, listed: DataFrame, bucket: str, database_of, at_once: int = 4) -> list[Load]:
    """Catalogue paths that exist under `bucket`, as files or datasets, each into a table of database_of(path)."""
    there = list_files(spark, bucket).select(dataset_of(below(F.col("path"), bucket)).alias("path")).distinct()
    found = there.join(listed.select("path").distinct(), "path").select(F.concat(F.lit(bucket.rstrip("/") + "/"), "path").alias("path"))
    files = named_files(found, bucket).orderBy("path")
    return _load_each(spark, [(f["path"], database_of(f["path"]), f["table"]) for f in files.toLocalIterator()], at_once)


def load_report(spark: SparkSession, loads: Sequence[Load]) -> DataFrame:
    """One row per file: path, table, state, rows_written, bad_rows, reason."""
    rows = [(x.path, x.table.split(".")[-1].strip("`"), x.state, x.rows_written, x.bad_rows, x.reason) for x in loads]
    return spark.createDataFrame(rows, "path string, table string, state string, rows_written long, bad_rows long, reason string")


def export_csv(df: DataFrame, path: str, order: Sequence[Column | str] = (), single_file: bool = False) -> None:
    """Ordered CSV export; part files follow the order. One file only on request."""
    out = df.orderBy(*order) if order else df
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").csv(path, header=True)


def load_audit(spark: SparkSession, load: Load, started: datetime | None = None) -> DataFrame:
    """One row about a load: when, from where, into what, rows written, bad rows; the counts are those taken while writing."""
    started = started or datetime.now(timezone.utc).replace(tzinfo=None)
    return load_report(spark, [load]).select(
        F.lit(started).cast("timestamp_ntz").alias("started"),
        F.col("path").alias("source_path"),
        F.element_at(F.split("path", "/"), -1).alias("source_name"),
        F.col("table").alias("table_name"),
        "rows_written",
        "bad_rows",
    )


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_csv(spark, path, ",", schema, multi_line=False)
