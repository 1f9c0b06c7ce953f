"""Registered queries on CSV, JSON and YAML ingestion.

Dirty files are written from the given tables into the shared scratch folder and
read back with the operators under test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.functions import headers as H
from chaintrail.operators.columns import collect_columns, flatten, sanitise_columns
from chaintrail.plans import fixtures as fx
from chaintrail.session import new_scratch
from chaintrail.sources import catalogue as K
from chaintrail.sources import csv_files as CSV
from chaintrail.sources import listing as L
from chaintrail.sources import tables as T

QUERIES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return register


DIRTY_NAMES = ["order key", "cust-key", "status(code)", "total price", "order date", "note;x"]
CLEAN_ORDERS = """
    SELECT CAST(o_orderkey AS {int}) AS order_key, CAST(o_custkey AS {int}) AS cust_key,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status_code_, o_totalprice AS total_price,
           CAST(o_orderdate AS DATE) AS order_date, concat(o_orderpriority, ';', o_orderstatus) AS note
    FROM orders"""


def _dirty_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with NA for a missing status, blanks around a key and delimiters inside a text."""
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("order key"),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("cust-key"),
        F.when(F.col("o_orderstatus") == "P", "NA").otherwise(F.col("o_orderstatus")).alias("status(code)"),
        F.col("o_totalprice").alias("total price"),
        F.col("o_orderdate").cast("date").cast("string").alias("order date"),
        F.concat_ws(";", "o_orderpriority", "o_orderstatus").alias("note"),
    )


def _write_csv(df: DataFrame, name: str, sep: str = ";", header: bool = True) -> str:
    path = new_scratch(df.sparkSession, name)
    df.write.csv(path, sep=sep, header=header, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def _scratch_database(spark: SparkSession) -> str:
    location = new_scratch(spark, "bronze")
    name = "bronze_" + location.rsplit("-", 1)[-1]
    T.create_database(spark, name, location)
    return name


@query("csv_ingest", CLEAN_ORDERS.format(int="INTEGER"))
def csv_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Header repaired, types inferred, saved as a described bronze table, read back."""
    path = _write_csv(_dirty_orders(spark, sf), "dirty-orders")
    return spark.table(T.load_csv(spark, path, _scratch_database(spark), table="bronze_orders"))


@query("csv_ingest_declared", CLEAN_ORDERS.format(int="BIGINT"))
def csv_ingest_declared(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_csv(_dirty_orders(spark, sf), "dirty-orders")
    return CSV.read_csv(
        spark,
        path,
        schema="order_key bigint, cust_key bigint, status_code_ string, total_price double, order_date date, note string",
        multi_line=False,
    )


_FOLDER = "SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 101 = 7 THEN concat('x', o_orderkey) ELSE CAST(o_orderkey AS VARCHAR) END AS mixed"


@query("csv_folder", _FOLDER + " FROM orders")
def csv_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of a folder as a table of its own, read back together.

    Each task writes files of one name to several folders; `mixed` turns from numbers to text late in a file.
    """
    rows = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("long").alias("order_key"),
        F.expr("CASE WHEN o_orderkey % 101 = 7 THEN concat('x', o_orderkey) ELSE CAST(o_orderkey AS STRING) END").alias("mixed"),
        (F.col("o_orderkey") % 3).alias("part"),
    )
    root = new_scratch(spark, "folder")
    rows.repartition(2, "order_key").sortWithinPartitions("part", F.col("mixed").startswith("x")).write.partitionBy("part").csv(root, header=True)
    tables = [spark.table(load.table) for load in T.load_csv_folder(spark, root, _scratch_database(spark))]
    tables = [t.select(F.col("order_key").cast("long"), F.col("mixed").cast("string")) for t in tables]
    return reduce(DataFrame.unionByName, tables)


@query(
    "csv_folder_report",
    """
    SELECT 'empty' AS state, 1 AS files, 0 AS rows_written
    UNION ALL SELECT 'loaded', 2, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)""",
)
def csv_folder_report(spark: SparkSession, sf: str) -> DataFrame:
    """A folder with an empty file, one of a single column, and one as usual: what became of each kind."""
    root = new_scratch(spark, "odd-folder")
    customers, suppliers = fx.table(spark, sf, "customer"), fx.table(spark, sf, "supplier")
    customers.select("c_custkey", "c_name").coalesce(1).write.csv(f"{root}/usual", header=True)
    suppliers.select("s_name").coalesce(1).write.csv(f"{root}/single", header=True)
    suppliers.where("false").select("s_name").coalesce(1).write.csv(f"{root}/nothing")
    loads = T.load_csv_folder(spark, root, _scratch_database(spark))
    return T.load_report(spark, loads).groupBy("state").agg(F.count("*").alias("files"), F.sum("rows_written").alias("rows_written"))


_LINES = """
    SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus = 'P' AS bad,
           CASE WHEN o_orderkey % 5 = 0 THEN concat('two', chr(10), 'lines') ELSE 'one' END AS note FROM orders"""


def _orders_with_bad_rows(spark: SparkSession, sf: str) -> str:
    """Orders with a note that may span lines, and no number where the status is P."""
    return _write_csv(
        fx.table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("order key"),
            F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("cust key"),
            F.when(F.col("o_orderkey") % 5 == 0, "two\nlines").otherwise("one").alias("note"),
        ),
        "bad-rows",
    )


_BAD_SCHEMA = "order_key bigint, cust_key bigint, note string"


@query(
    "csv_bad_records",
    f"""
    WITH line AS ({_LINES})
    SELECT order_key, cust_key, note, NULL AS record FROM line WHERE NOT bad
    UNION ALL SELECT NULL, NULL, NULL, concat(order_key, ';n/a;', CASE WHEN note = 'one' THEN note ELSE concat('"', note, '"') END) FROM line WHERE bad""",
)
def csv_bad_records(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = CSV.read_with_bad_records(spark, _orders_with_bad_rows(spark, sf), _BAD_SCHEMA)
    return good.withColumn("record", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@query(
    "ingest_audit",
    """
    SELECT 'bronze_orders' AS table_name, count(*) FILTER (WHERE o_orderstatus <> 'P') AS rows_written,
           count(*) FILTER (WHERE o_orderstatus = 'P') AS bad_rows
    FROM orders""",
)
def ingest_audit(spark: SparkSession, sf: str) -> DataFrame:
    load = T.load_file(spark, _orders_with_bad_rows(spark, sf), _scratch_database(spark), "bronze_orders", schema=_BAD_SCHEMA)
    return T.load_audit(spark, load).select("table_name", "rows_written", "bad_rows")


_PADDED = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {name} AS c_name, c_mktsegment FROM customer"


def _padded_customers(spark: SparkSession, sf: str) -> str:
    padded = fx.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" \t"), "c_name", F.lit("\t ")).alias("c_name"), "c_mktsegment")
    return _write_csv(padded, "padded-customers")


@query("csv_strings", _PADDED.format(name="concat(' ', chr(9), c_name, chr(9), ' ')"))
def csv_strings(spark: SparkSession, sf: str) -> DataFrame:
    return CSV.read_strings(spark, _padded_customers(spark, sf), multi_line=False)


@query("csv_trimmed", _PADDED.format(name="c_name"))
def csv_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    return CSV.read_trimmed(spark, _padded_customers(spark, sf), multi_line=False)


def _catalogue_files(spark: SparkSession, sf: str) -> str:
    """customer rows as CSV datasets <root>/c=<nation group>/d=<db>/f=<n>.csv"""
    root = new_scratch(spark, "bucket")
    fx.table(spark, sf, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey") % 5).alias("c"),
        F.concat(F.lit("db"), F.col("c_custkey") % 3).alias("d"),
        F.concat(F.lit("f"), F.col("c_custkey") % 5, F.lit(".csv")).alias("f"),
        "c_custkey",
        "c_name",
    ).repartition("c", "d", "f").write.partitionBy("c", "d", "f").csv(root, header=True)
    return root


def _relative(path: Column) -> Column:
    """Path of a dataset below the bucket, without partition labels."""
    parts = F.split(L.dataset_of(path), "/")
    return F.regexp_replace(F.array_join(F.slice(parts, -3, 3), "/"), "[cdf]=", "")


_PLACES = "SELECT concat('c=n', c_nationkey % 5) AS c, concat('d=db', c_custkey % 3) AS d, concat('f=f', c_custkey % 5, '.csv') AS f, * FROM customer"


@query(
    "list_csv_files",
    f"""
    SELECT concat_ws('/', c, d, f) AS dataset,
           CAST(sum(length(CAST(c_custkey AS VARCHAR)) + length(c_name) + 2) + length('c_custkey,c_name') + 1 AS BIGINT) AS length
    FROM ({_PLACES}) GROUP BY c, d, f""",
)
def list_csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each dataset with the bytes of its one file: header, and two values, a comma and a line break a row."""
    root = _catalogue_files(spark, sf)
    return L.list_csv_files(spark, root).select(L.dataset_of(L.below(F.col("path"), root)).alias("dataset"), "length")


@query(
    "dir_contents",
    f"""
    WITH p AS ({_PLACES})
    SELECT DISTINCT '' AS parent, c AS name, false AS is_file FROM p
    UNION ALL SELECT DISTINCT c, d, false FROM p
    UNION ALL SELECT DISTINCT concat_ws('/', c, d), f, false FROM p
    UNION ALL SELECT DISTINCT concat_ws('/', c, d, f), 'part', true FROM p""",
)
def dir_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Children of every folder; the part files' generated names are cut to 'part'."""
    return L.dir_contents(spark, _catalogue_files(spark, sf)).withColumn("name", F.regexp_replace("name", "^part-.*$", "part"))


def _silver(spark: SparkSession, sf: str) -> DataFrame:
    """One catalogue record per supplier, with paths that exist, do not, or are no CSV."""
    parts = [F.concat(F.lit("n"), F.col("s_nationkey") % 5), F.concat(F.lit("db"), F.col("s_suppkey") % 3)]
    path = lambda leaf: F.concat_ws("/", *parts, leaf)
    return fx.table(spark, sf, "supplier").select(
        parts[0].alias("namespace"),
        F.array(
            path(F.concat(F.lit("f"), F.col("s_suppkey") % 7, F.lit(".csv"))),
            path(F.concat(F.lit("f"), (F.col("s_suppkey") + 3) % 7, F.lit(".csv"))),
            path(F.lit("readme.txt")),
        ).alias("all_s3_records"),
    )


_LISTED = """
    WITH listed AS (SELECT DISTINCT path FROM (
             SELECT concat('n', s_nationkey % 5, '/db', s_suppkey % 3, '/f', s_suppkey % 7, '.csv') AS path FROM supplier
             UNION ALL SELECT concat('n', s_nationkey % 5, '/db', s_suppkey % 3, '/f', (s_suppkey + 3) % 7, '.csv') FROM supplier)),
         there AS (SELECT DISTINCT concat('n', c_nationkey % 5, '/db', c_custkey % 3, '/f', c_custkey % 5, '.csv') AS path FROM customer)
    SELECT path FROM listed WHERE path {test} (SELECT path FROM there)"""


@query("catalog_csvs", _LISTED.format(test="IN"))
def catalog_csvs(spark: SparkSession, sf: str) -> DataFrame:
    files = L.list_files(spark, _catalogue_files(spark, sf))
    return K.existing(K.catalogue_csvs(_silver(spark, sf)), files, _relative(F.col("path")))[0]


@query("missing_files", _LISTED.format(test="NOT IN"))
def missing_files(spark: SparkSession, sf: str) -> DataFrame:
    files = L.list_files(spark, _catalogue_files(spark, sf))
    return K.existing(K.catalogue_csvs(_silver(spark, sf)), files, _relative(F.col("path")))[1]


@query(
    "catalog_csvs_of_db",
    """
    SELECT DISTINCT path FROM (
        SELECT concat('n3/db', s_suppkey % 3, '/f', s_suppkey % 7, '.csv') AS path, s_suppkey FROM supplier WHERE s_nationkey % 5 = 3
        UNION ALL SELECT concat('n3/db', s_suppkey % 3, '/f', (s_suppkey + 3) % 7, '.csv'), s_suppkey FROM supplier WHERE s_nationkey % 5 = 3)
    WHERE path LIKE 'n3/db1/%'""",
)
def catalog_csvs_of_db(spark: SparkSession, sf: str) -> DataFrame:
    return K.catalogue_csvs(_silver(spark, sf), "n3", "db1")


@query(
    "catalogue_tables",
    """
    WITH listed AS (SELECT s_suppkey % 7 AS f FROM supplier WHERE s_nationkey % 5 = 3 AND s_suppkey % 3 = 1
                    UNION SELECT (s_suppkey + 3) % 7 FROM supplier WHERE s_nationkey % 5 = 3 AND s_suppkey % 3 = 1)
    SELECT concat('bronze_f_f', c_custkey % 5) AS table_name, CAST(c_custkey AS BIGINT) AS c_custkey, c_name
    FROM customer WHERE c_nationkey % 5 = 3 AND c_custkey % 3 = 1 AND c_custkey % 5 IN (SELECT f FROM listed)""",
)
def catalogue_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The datasets that the catalogue lists for one database and that exist, loaded and read back."""
    root, database = _catalogue_files(spark, sf), _scratch_database(spark)
    listed = K.catalogue_csvs(_silver(spark, sf), "n3", "db1")
    parts = F.split("path", "/")
    folders = [F.concat(F.lit(f"{c}="), F.get(parts, F.lit(i))) for i, c in enumerate("cdf")]
    loads = T.load_catalogue_csvs(spark, listed.select(F.concat_ws("/", *folders).alias("path")), root, lambda path: database)
    tables = [
        spark.table(x.table).select(F.lit(x.table.split("`")[-2]).alias("table_name"), F.col("c_custkey").cast("long"), "c_name") for x in loads
    ]
    none = spark.createDataFrame([], "table_name string, c_custkey long, c_name string")  # no dataset may be listed
    return reduce(DataFrame.unionByName, tables, none)


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue records as nested structs; the second table is missing in half of them."""
    table = lambda path: F.struct(F.struct(path.alias("s3_object")).alias("options"))
    even = F.col("s_suppkey") % 2 == 0
    return fx.table(spark, sf, "supplier").select(
        F.concat(F.lit("n"), "s_nationkey").alias("namespace"),
        F.col("s_name").alias("name"),
        F.struct(
            table(F.concat_ws("/", F.lit("a"), "s_suppkey")).alias("2017"),
            F.when(even, table(F.concat_ws("/", F.lit("b"), "s_suppkey"))).alias("2013-2019"),
        ).alias("external_tables"),
    )


_FLAT = """
    SELECT concat('n', s_nationkey) AS namespace, s_name AS name, concat('a/', s_suppkey) AS external_tables_2017_options_s3_object,
           CASE WHEN s_suppkey % 2 = 0 THEN concat('b/', s_suppkey) END AS external_tables_2013{dash}2019_options_s3_object
           {more}
    FROM supplier"""
_FLAT_RAW = """
    SELECT concat('n', s_nationkey) AS namespace, s_name AS name, concat('a/', s_suppkey) AS external_tables_2017_options_s3_object,
           CASE WHEN s_suppkey % 2 = 0 THEN concat('b/', s_suppkey) END AS "external_tables_2013-2019_options_s3_object"
    FROM supplier"""
_PATHS = """array_to_string(CASE WHEN s_suppkey % 2 = 0 THEN ['b/' || s_suppkey, 'a/' || s_suppkey] ELSE ['a/' || s_suppkey] END, ',') AS all_s3_records"""


@query("json_nested_scan", _FLAT_RAW)
def json_nested_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = new_scratch(spark, "nested-json")
    _nested(spark, sf).write.json(path)
    return flatten(K.read_nested_json(spark, path, multi_line=False))


@query("flatten_nested", _FLAT_RAW)
def flatten_nested(spark: SparkSession, sf: str) -> DataFrame:
    return flatten(_nested(spark, sf))


@query("collect_paths", f"SELECT s_name AS name, {_PATHS} FROM supplier")
def collect_paths(spark: SparkSession, sf: str) -> DataFrame:
    flat = flatten(_nested(spark, sf))
    by_name = flat.select(*sorted(flat.columns))
    return collect_columns(by_name).select("name", F.array_join("all_s3_records", ",").alias("all_s3_records"))


def _yaml_files(spark: SparkSession, sf: str) -> str:
    path = new_scratch(spark, "catalogue-yaml")
    key = F.col("s_suppkey").cast("string")
    second = F.when(
        F.col("s_suppkey") % 2 == 0, F.concat(F.lit('\n    "2013-2019":\n      options:\n        s3_object: b/'), key)
    ).otherwise("")
    text = F.concat(
        F.lit("- namespace: n"), F.col("s_nationkey").cast("string"),
        F.lit("\n  name: '"), F.col("s_name"),
        F.lit("'\n  external_tables:\n    '2017':\n      options:\n        s3_object: a/"), key, second,
    )
    fx.table(spark, sf, "supplier").select(text.alias("value")).write.text(path)
    return path


_YAML_SCHEMA = (
    "namespace string, name string, external_tables struct<`2017`: struct<options: struct<s3_object: string>>, "
    "`2013-2019`: struct<options: struct<s3_object: string>>>"
)


@query("yaml_catalog", _FLAT_RAW)
def yaml_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return flatten(K.read_yaml(spark, _yaml_files(spark, sf), _YAML_SCHEMA))


@query("silver_catalog", _FLAT.format(dash="_", more=", " + _PATHS))
def silver_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Types inferred from the records, flattened, paths collected."""
    path = new_scratch(spark, "nested-json")
    _nested(spark, sf).write.json(path)
    flat = K.silver_catalogue(K.read_nested_json(spark, path, multi_line=False))
    return flat.withColumn("all_s3_records", F.array_join("all_s3_records", ","))


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    """A header per part: several delimiters, special characters, carriage returns."""
    key = F.col("p_partkey")
    sep = F.get(F.array(F.lit(";"), F.lit(","), F.lit("\t"), F.lit("|")), (key % 4).cast("int"))
    mark = F.get(F.array(F.lit("(kg)"), F.lit("\rx"), F.lit(""), F.lit("-é%"), F.lit("_")), (key % 5).cast("int"))
    return fx.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("a b"), mark, sep, F.col("p_type"), F.lit(" c"), sep, F.lit("d")).alias("header")
    )


_HEADER = """
    SELECT p_partkey, concat('a b', m, s, p_type, ' c', s, 'd') AS header, s FROM (
        SELECT *, [';', ',', chr(9), '|'][p_partkey % 4 + 1] AS s,
               ['(kg)', chr(13) || 'x', '', '-é%', '_'][p_partkey % 5 + 1] AS m
        FROM part)"""


@query("detect_delimiter", f"SELECT p_partkey, s AS delimiter FROM ({_HEADER})")
def detect_delimiter(spark: SparkSession, sf: str) -> DataFrame:
    return _headers(spark, sf).select("p_partkey", H.delimiter_of(F.col("header")).alias("delimiter"))


@query(
    "header_bad_chars",
    f"""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '()' WHEN 3 THEN '%-é' ELSE '' END AS bad FROM ({_HEADER})""",
)
def header_bad_chars(spark: SparkSession, sf: str) -> DataFrame:
    return _headers(spark, sf).select("p_partkey", F.array_join(H.forbidden_chars(F.col("header")), "").alias("bad"))


@query(
    "sanitize_header",
    f"""
    SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 3)
                           THEN replace(regexp_replace(replace(header, chr(13), '_'), '[()%é-]', '_', 'g'), ' ', '_') ELSE header END AS header,
           regexp_replace(header, '[^0-9a-zA-Z,;|\t]+', '_', 'g') AS collapsed
    FROM ({_HEADER})""",
)
def sanitize_header(spark: SparkSession, sf: str) -> DataFrame:
    header = F.col("header")
    return _headers(spark, sf).select(
        "p_partkey", H.repair_header(header).alias("header"), H.repair_header(header, collapse=True).alias("collapsed")
    )


@query(
    "sanitize_columns",
    'SELECT o_orderkey AS order_key, o_custkey AS order_key_1, o_orderstatus AS "status_code_", o_orderpriority AS pr_ior FROM orders',
)
def sanitize_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return sanitise_columns(df.toDF("order key", "order--key", "status (code)", "pr.ior"))


def _file_names(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("CD_"), F.col("o_orderstatus"), F.lit(" ("), key, F.lit(")-v2.CSV"))
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        name.alias("file_name"),
        F.concat(F.lit("s3://bucket/n"), F.col("o_custkey").cast("string"), F.lit("/trade/"), name).alias("path"),
        F.concat(F.lit("a/b/CD_"), key, F.lit(".v1.csv")).alias("key"),
    )


@query("bronze_names", "SELECT o_orderkey, concat('bronze_cd_', lower(o_orderstatus), '_', o_orderkey, '_v2') AS table_name FROM orders")
def bronze_names(spark: SparkSession, sf: str) -> DataFrame:
    return _file_names(spark, sf).select("o_orderkey", H.bronze_name(F.col("file_name")).alias("table_name"))


@query("path_namespace", "SELECT o_orderkey, concat('n', o_custkey) AS catalog, 'trade' AS db FROM orders")
def path_namespace(spark: SparkSession, sf: str) -> DataFrame:
    catalog, db = H.namespace_of(F.col("path"))
    return _file_names(spark, sf).select("o_orderkey", catalog.alias("catalog"), db.alias("db"))


@query("dataset_names", "SELECT o_orderkey, concat('CD_', o_orderkey) AS dataset FROM orders")
def dataset_names(spark: SparkSession, sf: str) -> DataFrame:
    return _file_names(spark, sf).select("o_orderkey", H.dataset_name(F.col("key")).alias("dataset"))


@query(
    "table_properties",
    "SELECT * FROM (VALUES ('source_delimiter', ';'), ('write_mode', 'overwrite'), ('rows', (SELECT CAST(count(*) AS VARCHAR) FROM orders))) v(key, value)",
)
def table_properties(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_csv(_dirty_orders(spark, sf), "dirty-orders")
    name = T.load_csv(spark, path, _scratch_database(spark), table="bronze_orders")
    T.describe_table(spark, name, "orders", {"rows": str(spark.table(name).count())})
    return T.table_properties(spark, name, ["source_delimiter", "write_mode", "rows"])
