from pyspark.sql import functions as F

from chaintrail.functions import headers as H
from chaintrail.functions.measures import fingerprint, freshness, significant, whole_months
from chaintrail.functions.text import cap_open_age, clean_breaks, lower_age_of, map_values, sex_of, simple_code, strip_space, upper_age_of
from chaintrail.sources import csv_files as CSV


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def months(spark, a, b):
    return one(spark, whole_months(F.lit(a).cast("date"), F.lit(b).cast("date")))


def test_whole_months_truncate_toward_zero(spark):
    assert months(spark, "2020-01-31", "2020-02-29") == 0
    assert months(spark, "2020-01-31", "2020-03-31") == 2
    assert months(spark, "2020-03-31", "2020-01-31") == -2
    assert months(spark, "2020-03-01", "2020-01-31") == -1


def test_descriptions(spark):
    d = F.lit("BOVINO,FEMEA,13 A 24 MESES")
    assert one(spark, sex_of(d)) == "FEMEA"
    assert (one(spark, lower_age_of(d)), one(spark, upper_age_of(d))) == (13, 24)
    old = F.lit("BOVINO,MACHO,ACIMA DE 36 MESES")
    assert one(spark, cap_open_age(lower_age_of(old), upper_age_of(old))) == 42
    none = F.lit("SEM IDADE")
    assert one(spark, sex_of(none)) is None
    assert one(spark, lower_age_of(none)) is None
    assert one(spark, upper_age_of(none)) is None


def test_codes_and_text(spark):
    assert one(spark, simple_code(F.lit("PPA-17"))) == 17
    assert one(spark, simple_code(F.lit("17"))) == 17
    assert one(spark, clean_breaks(F.lit("a\r\nb"))) == "a  b"
    assert one(spark, strip_space(F.lit("\t a b \n"))) == "a b"
    assert one(spark, map_values(F.lit("x"), {"x": "1"})) == "1"
    assert one(spark, map_values(F.lit("y"), {"x": "1"})) is None


def test_fingerprints_tell_null_from_nothing(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "", "b"), ("a:1", "", "b")], "x string, y string, z string")
    for mode in ("md5", "xxhash64"):
        assert rows.select(fingerprint(rows.columns, mode).alias("h")).distinct().count() == 4
    # the 32-bit mode skips nulls, as documented
    assert rows.limit(2).select(fingerprint(rows.columns, "hash32").alias("h")).distinct().count() == 1


def test_freshness(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, freshness(t("2020-01-02"), t("2020-01-01"))) == "newer"
    assert one(spark, freshness(t("2020-01-01"), t("2020-01-01"))) == "same"
    assert one(spark, freshness(t("2019-01-01"), t("2020-01-01"))) == "inconsistent"
    assert one(spark, freshness(t("2019-01-01"), t(None))) == "newer"


#: header -> (delimiter, does it need repair, repaired)
HEADERS = {
    "a;b c;d": (";", False, "a;b c;d"),
    "a\rb,c d": (",", True, "a_b,c_d"),
    "x(kg)|y": ("|", True, "x_kg_|y"),
    "plain": (None, False, "plain"),
    "tab\tb\r": ("\t", False, "tab\tb\r"),
    '"q";r': (";", True, "_q_;r"),
    "é;f": (";", True, "_;f"),
    "a;b\r": (";", False, "a;b\r"),
    "\ra;b": (";", False, "\ra;b"),
    "a b,c;d(e)": (",", True, "a_b,c;d_e_"),
}


def test_header_rules(spark):
    df = spark.createDataFrame([(h,) for h in HEADERS], "h string")
    h = F.col("h")
    got = df.select("h", H.delimiter_of(h).alias("d"), H.needs_repair(h).alias("n"), H.repair_header(h).alias("r")).collect()
    assert {row["h"]: (row["d"], row["n"], row["r"]) for row in got} == HEADERS
    assert one(spark, H.bronze_name(F.lit("CD_Ecuador (2013).CSV"))) == "bronze_cd_ecuador_2013"


def test_header_of_a_file(spark, tmp_path):
    for text, want in (
        ("a b(x); c \n1;2\n", CSV.Header(";", True, ["a_b_x_", "_c_"])),
        ("a b; c \r\n1;2\n", CSV.Header(";", False, ["a b", "c"])),
        ("only one\n1\n", CSV.Header(";", False, ["only one"])),
        ("", None),
        ("\n\n", None),
    ):
        (tmp_path / "f.csv").write_bytes(text.encode())
        assert CSV.read_header(spark, str(tmp_path / "f.csv")) == want


def test_names_stay_unique():
    assert H.sanitise_names(["a b", "a-b", "A_B", "c"]) == ["a_b", "a_b_1", "A_B_2", "c"]


def test_paths(spark):
    catalog, db = H.namespace_of(F.lit("s3://bucket/brazil/beef/out/x.csv"))
    assert (one(spark, catalog), one(spark, db)) == ("brazil", "beef")
    assert one(spark, H.dataset_name(F.lit("a/b/CD_2013.v2.csv"))) == "CD_2013"


def test_small_scores_keep_their_order(spark):
    rows = spark.createDataFrame([(1e-12,), (1.00001e-12,), (3.0,), (None,), (0.0,)], "v double")
    got = [r[0] for r in rows.select(significant(F.col("v"))).collect()]
    assert got == [1e-12, 1.00001e-12, 3.0, None, 0.0]
