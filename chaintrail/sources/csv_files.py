"""CSV scans: option set, header repair, bad records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaintrail.functions.headers import delimiter_of, needs_repair, repair_header, sanitise_names
from chaintrail.functions.text import strip_space
from chaintrail.session import materialise

# Defaults of the loader, other names of encodings.
ENCODING_NAMES = {"utf8": "UTF-8", "latin1": "ISO-8859-1"}
NULL_TOKEN = "NA"
DELIMITER = ";"
ENCODING = "UTF-8"
CORRUPT = "_corrupt_record"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = DELIMITER,
    schema: T.StructType | str | None = None,
    header: bool = True,
    encoding: str = ENCODING,
    null_value: str = NULL_TOKEN,
    multi_line: bool | None = None,
    line_sep: str | None = None,
    **options: object,
) -> DataFrame:
    """CSV scan with the loader's options. Types are inferred unless a schema is given.

    multi_line lets quoted fields hold line breaks, at the price of one task per
    file. By default the lines themselves decide: files without such fields are
    split, whatever their size. A header is always skipped, also under a given schema.
    """
    multi_line = spans_lines(spark, path) if multi_line is None else multi_line
    reader = (
        spark.read.option("sep", delimiter)
        .option("header", header)
        .option("encoding", ENCODING_NAMES.get(encoding, encoding))
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("multiLine", multi_line)
        .option("nullValue", null_value)
    )
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    for key, value in options.items():
        reader = reader.option(key, value)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).option("enforceSchema", True).csv(path)


@dataclass
class Header:
    """The header line of a file: its delimiter, whether it needs repair, and its clean names."""

    delimiter: str
    damaged: bool
    names: list[str]


def read_header(spark: SparkSession, path: str) -> Header | None:
    """The header, judged where its line is read; one small task, whatever the file size. None for an empty file.

    A header without any delimiter is that of a table with one column.
    """
    line = F.col("value")
    first = spark.read.text(path, lineSep="\n").where(F.col("_metadata.file_block_start") == 0)
    rows = first.select(
        F.coalesce(delimiter_of(line), F.lit(DELIMITER)).alias("delimiter"),
        F.coalesce(needs_repair(line), F.lit(False)).alias("damaged"),
        F.rtrim(repair_header(line), F.lit("\r")).alias("repaired"),
    ).take(1)
    if not rows or not rows[0]["repaired"].strip():
        return None
    delimiter, damaged, repaired = rows[0]
    return Header(delimiter, damaged, [n.strip() for n in repaired.split(delimiter)])


def spans_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted field may hold a line break, seen from the lines alone.

    Such a field leaves a line with an odd number of quotes. An escaped quote is
    not followed up and counts as a yes. Lines are split between tasks.
    """
    line = F.col("value")
    quotes = F.length(line) - F.length(F.translate(line, '"', ""))
    odd = (quotes % 2 == 1) | F.contains(line, F.lit('\\"'))
    return not spark.read.text(path, lineSep="\n").where(odd).isEmpty()


def read_repaired(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    corrupt: str | None = None,
    **options: object,
) -> tuple[DataFrame, str]:
    """(frame, delimiter): delimiter found and header repaired while reading.

    A header that needs repair gives clean column names, and carriage returns left
    in the body become blanks; no copy of the file is written. Only the header line
    reaches the driver. With `corrupt`, that column holds the text of rows that do
    not fit.
    """
    header = read_header(spark, path)
    if header is None:
        raise ValueError(f"{path} is empty")
    multi_line = spans_lines(spark, path) if multi_line is None else multi_line
    delimiter, damaged, names = header.delimiter, header.damaged, header.names
    if schema is None:
        found = read_csv(spark, path, delimiter, multi_line=multi_line, line_sep="\n", **options).schema
        kinds = [f.dataType for f in found.fields]
        kinds += [T.StringType()] * (len(names) - len(kinds))
        unique = sanitise_names(names, " ")
        schema = T.StructType([T.StructField(n, t) for n, t in zip(unique, kinds, strict=False)])
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        options = {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    df = read_csv(spark, path, delimiter, schema, multi_line=multi_line, line_sep="\n", **options)
    if damaged:
        df = df.withColumns({c: F.translate(F.col(f"`{c}`"), "\r", " ") for c in texts})
    return df, delimiter


def read_with_bad_records(
    spark: SparkSession, path: str, schema: str, delimiter: str = DELIMITER, **options: object
) -> tuple[DataFrame, DataFrame]:
    """(good rows, raw text of rows that do not fit the schema).

    The parsed rows are written once: both results then rest on the same full parse,
    whatever columns are used later. Quoted fields may hold line breaks, as elsewhere.
    """
    whole = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    parsed = read_csv(spark, path, delimiter, whole, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options)
    df = materialise(parsed, "parsed")
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"))


def row_position() -> Column:
    """Place of a row in the files it was read from, as a value to sort by.

    Path, start of the block and order inside the block: the same order however the files are
    cut into tasks. For the frame of a scan only.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_strings(
    spark: SparkSession, path: str, sep: str = DELIMITER, encoding: str = ENCODING, multi_line: bool | None = None, position: str = ""
) -> DataFrame:
    """Plain scan, every column a string; `position` names a column for the place of each row."""
    multi_line = spans_lines(spark, path) if multi_line is None else multi_line
    df = spark.read.csv(path, sep=sep, encoding=ENCODING_NAMES.get(encoding, encoding), header=True, multiLine=multi_line)
    return df.withColumn(position, row_position()) if position else df


def read_trimmed(
    spark: SparkSession, path: str, sep: str = DELIMITER, encoding: str = ENCODING, multi_line: bool | None = None, position: str = ""
) -> DataFrame:
    """Plain scan with white space of any kind stripped from every value."""
    df = read_strings(spark, path, sep, encoding, multi_line, position)
    return df.select(*[F.col(f"`{c}`") if c == position else strip_space(F.col(f"`{c}`")).alias(c) for c in df.columns])
