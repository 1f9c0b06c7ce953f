"""Ingestion, replication, registry and allocation on hand-made inputs."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chaintrail.operators import allocate as A
from chaintrail.operators import registry as G
from chaintrail.operators import replicate as R
from chaintrail.operators.columns import duplicates, flatten, keep_first, rename_strict
from chaintrail.sources import catalogue as K
from chaintrail.sources import csv_files as CSV
from chaintrail.sources import jdbc
from chaintrail.sources import tables as T


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


DIRTY = 'na me\rx;col-b;c(kg)\r\n1;a\rb;2.5\r\n NA;"x;y";3\r\n2;"two\nlines";NA\r\n'


def test_header_with_carriage_return(spark, tmp_path):
    df, delimiter = CSV.read_repaired(spark, write(tmp_path / "a.csv", DIRTY))
    assert delimiter == ";" and df.columns == ["na_me_x", "col_b", "c_kg__"]
    assert [tuple(r) for r in df.collect()] == [(1, "a b", 2.5), (None, "x;y", 3.0), (2, "two\nlines", None)]
    assert dict(df.dtypes)["c_kg__"] == "double"


def test_clean_header_leaves_the_body_alone(spark, tmp_path):
    df, _ = CSV.read_repaired(spark, write(tmp_path / "a.csv", "a b,c\n1,x\ry\n"))
    assert df.columns == ["a_b", "c"] and df.first()["c"] == "x\ry"


def test_folder_becomes_tables(spark, tmp_path):
    write(tmp_path / "in/one (1).csv", DIRTY)
    write(tmp_path / "in/deep/Two.CSV", "a|b\n1|2\n")
    write(tmp_path / "in/big.csv", "a|b\n" + "1|2\n" * 300)
    write(tmp_path / "in/readme.txt", "no table")
    T.create_database(spark, "bronze_folder", str(tmp_path / "db"))
    loads = T.load_csv_folder(spark, str(tmp_path / "in"), "bronze_folder", max_bytes=600)
    assert {x.table.split(".")[1].strip("`") for x in loads} == {"bronze_two", "bronze_one_1"}  # big.csv is above the caller's limit
    assert len(T.load_csv_folder(spark, str(tmp_path / "in"), "bronze_folder")) == 3
    assert spark.table("bronze_folder.bronze_big").count() == 300
    assert spark.table("bronze_folder.bronze_two").count() == 1
    stamped = {r["key"]: r["value"] for r in T.table_properties(spark, "bronze_folder.bronze_two", ["source_delimiter", "write_mode"]).collect()}
    assert stamped == {"source_delimiter": "|", "write_mode": "overwrite"}


def test_files_of_one_name_become_two_tables(spark, tmp_path):
    write(tmp_path / "in/a/x.csv", "k;v\n1;2\n")
    write(tmp_path / "in/b/x.csv", "k;v\n3;4\n")
    names = [x.table for x in T.load_csv_folder(spark, str(tmp_path / "in"), "bronze_twice")]
    assert len(set(names)) == 2 and sorted(spark.table(n).first()["k"] for n in names) == [1, 3]
    paths = ["/r/a/b.csv", "/r/a_b.csv", "/r/c/b.csv", "/r/a b.csv", "/r/A/b.csv"]
    named = T.named_files(spark.createDataFrame([(p, 1) for p in paths], "path string, length long"), "/r").collect()
    assert len({r["table"] for r in named}) == 5 and {r["length"] for r in named} == {1}


def test_a_folder_with_odd_files_loads_the_rest(spark, tmp_path):
    write(tmp_path / "in/usual.csv", "k;v\n1;2\n3;4\n")
    write(tmp_path / "in/single.csv", "only\nx\ny\nz\n")
    write(tmp_path / "in/empty.csv", "")
    write(tmp_path / "in/blank.csv", "\n")
    write(tmp_path / "in/head.csv", "a;b\n")
    (tmp_path / "in/broken.csv.gz").write_bytes(b"\x1f\x8b not gzip at all")
    loads = T.load_csv_folder(spark, str(tmp_path / "in"), "bronze_odd")
    states = {x.path.rsplit("/", 1)[-1]: (x.state, x.rows_written) for x in loads}
    assert states == {
        "usual.csv": ("loaded", 2), "single.csv": ("loaded", 3), "empty.csv": ("empty", 0), "blank.csv": ("empty", 0),
        "head.csv": ("loaded", 0), "broken.csv.gz": ("failed", 0),
    }
    assert spark.table("bronze_odd.bronze_single").columns == ["only"] and spark.table("bronze_odd.bronze_head").columns == ["a", "b"]
    report = {r["state"]: r["reason"] for r in T.load_report(spark, loads).collect()}
    assert report["failed"] and not report["loaded"]


def test_bad_rows_between_rows_that_span_lines(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a;b\n1;"x\ny"\nbad;"p\nq"\n2;z\n3;4;5\n')
    good, bad = CSV.read_with_bad_records(spark, path, "a int, b string")
    assert sorted(map(tuple, good.collect())) == [(1, "x\ny"), (2, "z")]
    assert sorted(r[0] for r in bad.collect()) == ["3;4;5", 'bad;"p\nq"']
    T.create_database(spark, "bronze_span", str(tmp_path / "db"))
    load = T.load_file(spark, path, "bronze_span", "t", schema="a int, b string")
    assert (load.rows_written, load.bad_rows) == (2, 2)
    assert T.load_audit(spark, load).select("source_name", "rows_written", "bad_rows").collect() == [("a.csv", 2, 2)]
    assert sorted(r[0] for r in spark.table("bronze_span.t_bad_records").collect()) == ["3;4;5", 'bad;"p\nq"']


@pytest.mark.parametrize("block", ["128m", "300"])
def test_reading_order_does_not_depend_on_the_splits(spark, tmp_path, block):
    rows = "".join(f"PPA-{i % 40};n{i % 40};a{i % 2};t{i};c{i % 3}\n" for i in range(200))
    path = write(tmp_path / "df.csv", "CODIGO;NOMBRE;DIRECCION_ESTABLECIMIENTO;TELEFONOS;CONTACTO\n" + rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        read = CSV.read_trimmed(spark, path, ";", position="row_id")
        assert block == "128m" or read.rdd.getNumPartitions() > 5
        kept = G.facility_list([read], copies_of=1).collect()
        order = [r["TELEFONOS"] for r in read.orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert order == [f"t{i}" for i in range(200)]
    first = {}
    for i in range(200):
        first.setdefault((i % 40, i % 2, i % 3), f"t{i}")
    assert sorted(r["TELEPHONE"] for r in kept) == sorted(first.values())


def test_rows_are_loaded_alike_at_every_size(spark, tmp_path):
    """Values that change after many rows widen the type; a file of 11 MB keeps its rows as one of 1 MB does."""
    T.create_database(spark, "bronze_sizes", str(tmp_path / "db"))
    for name, pad in (("small", 1), ("large", 90)):
        rows = "".join(f"{i if i < 100_000 else i + 0.5};{'p' * pad}\n" for i in range(120_000))
        table = spark.table(T.load_csv(spark, write(tmp_path / f"{name}.csv", "v;pad\n" + rows), "bronze_sizes"))
        assert table.count() == 120_000 and dict(table.dtypes)["v"] == "double" and table.where("v IS NULL").isEmpty()


def test_line_breaks_in_fields(spark, tmp_path):
    path = write(tmp_path / "lines.csv", 'id;t\n1;"two\nlines"\n2;x\n')
    assert CSV.spans_lines(spark, path)
    T.create_database(spark, "bronze_lines", str(tmp_path / "db"))
    assert sorted(map(tuple, spark.table(T.load_csv(spark, path, "bronze_lines")).collect())) == [(1, "two\nlines"), (2, "x")]


def test_bad_records_of_an_earlier_load_go(spark, tmp_path):
    T.create_database(spark, "bronze_late", str(tmp_path / "db"))
    path = write(tmp_path / "late.csv", "id;t\n1;x\n2;y;z\n")
    name = T.load_csv(spark, path, "bronze_late")
    assert spark.table("bronze_late.bronze_late_bad_records").collect() == [("2;y;z",)]
    write(tmp_path / "late.csv", "id;t\n1;x\n")
    assert T.load_csv(spark, path, "bronze_late") == name and spark.table(name).count() == 1
    assert not spark.catalog.tableExists("bronze_late.bronze_late_bad_records")


def test_pipeline_inputs(spark, tmp_path):
    paths = {n: write(tmp_path / f"{n}.csv", f"A{s}B\n x {s}\ty\n") for n, s in G.INPUT_FILES.items()}
    inputs = G.registry_inputs(spark, paths)
    assert len(inputs) == 9 and all(df.drop("row_id").collect() == [("x", "y")] for df in inputs.values())
    ponds_path = write(tmp_path / "ponds.csv", "POND_TRASE_ID;PARISH_TRASE_ID;AREA_HA\np;A;2\n")
    flow = "TOTAL.Net.Weight..Kg.;Harmonized.Code.Product.Spanish\n{};030616\n"
    flow_paths = {y: write(tmp_path / f"{y}.csv", flow.format(950 * (y - 2012))) for y in (2013, 2014)}
    ponds, flows = A.production_inputs(spark, ponds_path, flow_paths)
    made = A.production_per_parish(ponds, A.product_flows(flows), [2013, 2014])
    assert {r["YEAR"]: round(r["avg_produced_tons"], 9) for r in made.collect()} == {"2013": 1.0, "2014": 2.0}
    area = A.area_per_parish(made, 2014)
    T.export_csv(area, str(tmp_path / "out"), ["PARISH_TRASE_ID"], single_file=True)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    assert T.read_export(spark, str(tmp_path / "out"), "PARISH_TRASE_ID string, AREA_HA double").collect() == [("A", 2.0)]


def test_bad_records_do_not_depend_on_chosen_columns(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a;b\n1;2\nx;3\n4;5;6\n7;y\n")
    good, bad = CSV.read_with_bad_records(spark, path, "a int, b int")
    assert good.select("a").collect() == [(1,)]
    assert sorted(r[0] for r in bad.collect()) == ["4;5;6", "7;y", "x;3"]


def test_yaml_catalogue(spark, tmp_path):
    text = """# all of them
---
repositories:
- namespace: brazil
  external_tables:
    2017:
      options:
        s3_object: brazil/beef/a.csv
    2013-2019:
      options:
        s3_object: brazil/soy/b.txt
- namespace: peru
  tags:
  - x
  - y
"""
    nested, flat = K.build_silver(spark, write(tmp_path / "c.yml", text))
    assert flat.count() == 2
    rows = {r["namespace"]: r for r in flat.collect()}
    assert sorted(rows["brazil"]["all_s3_records"]) == ["brazil/beef/a.csv", "brazil/soy/b.txt"]
    assert rows["peru"]["all_s3_records"] == [] and rows["peru"]["tags"] == ["x", "y"]
    assert "external_tables_2013_2019_options_s3_object" in flat.columns
    assert [r[0] for r in K.catalogue_csvs(flat, "brazil").collect()] == ["brazil/beef/a.csv"]
    assert K.catalogue_csvs(flat, "brazil", "soy").count() == 0


def test_catalogue_files_that_exist_become_tables(spark, tmp_path):
    write(tmp_path / "bucket/brazil/beef/a.csv", "a;b\n1;2\n")
    listed = spark.createDataFrame([("brazil/beef/a.csv",), ("brazil/beef/gone.csv",)], "path string")
    T.create_database(spark, "brazil__beef", str(tmp_path / "db"))
    (load,) = T.load_catalogue_csvs(spark, listed, str(tmp_path / "bucket"), lambda p: "brazil__beef")
    assert load.table == "`brazil__beef`.`bronze_a`" and spark.table(load.table).count() == 1


def test_flatten_keeps_arrays_and_odd_names(spark):
    df = spark.sql("SELECT named_struct('x-1', named_struct('y.z', 1), 'k', array(1, 2)) AS a, 'v' AS b")
    flat = flatten(df)
    assert set(flat.columns) == {"b", "a_k", "a_x-1_y.z"} and flat.first()["a_k"] == [1, 2]


def test_strict_rename(spark):
    df = spark.createDataFrame([(1,)], ["a.b."])
    assert rename_strict(df, {"a.b.": "c"}).columns == ["c"]
    with pytest.raises(KeyError):
        rename_strict(df, {"x": "y"})


def test_keep_first_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(2, None, "late"), (1, None, "early"), (3, "k", "only")], "n int, k string, v string")
    assert {tuple(r) for r in keep_first(df, ["k"], ["n"]).collect()} == {(1, None, "early"), (3, "k", "only")}
    assert [tuple(r) for r in duplicates(df, "k").collect()] == [(None, 2)]


# --- replication

SOURCE = "id long, name string, seen timestamp_ntz"


def frame(spark, *rows, seen="2020-01-01 00:00:00"):
    return spark.createDataFrame([(i, n) for i, n in rows], "id long, name string").withColumn("seen", F.lit(seen).cast("timestamp_ntz"))


def state(spark, name, version=None):
    return sorted(tuple(r) for r in R.as_of(spark.table(name), version).select("id", "name").collect())


@pytest.fixture
def database(spark, tmp_path):
    name = "replica_" + uuid.uuid4().hex
    T.create_database(spark, name, str(tmp_path / "db"))
    return name


def test_replication_cycle(spark, database):
    log = f"{database}.t"
    first = frame(spark, (1, "a"), (2, "b"), (2, "b"), (3, None))
    assert R.replicate(first, log, refresh_field="seen").action == "created"
    assert R.replicate(first, log, refresh_field="seen").action == "up-to-date"

    # one new and one stale row: both sides count the same, the stale row must still go
    second = frame(spark, (1, "a"), (2, "b"), (2, "b"), (4, "d"), seen="2020-02-01 00:00:00")
    outcome = R.replicate(second, log, refresh_field="seen")
    assert (outcome.action, outcome.inserted, outcome.deleted, outcome.version) == ("changed", 1, 1, 1)
    assert state(spark, log) == [(1, "a"), (2, "b"), (2, "b"), (4, "d")]
    assert state(spark, log, 0) == sorted([(1, "a"), (2, "b"), (2, "b"), (3, None)])

    # an older source is suspect but still compared; a row that left comes back, another gains and one loses copies
    third = frame(spark, (1, "a"), (1, "a"), (1, "a"), (2, "b"), (3, None), seen="2019-01-01 00:00:00")
    outcome = R.replicate(third, log, refresh_field="seen")
    assert (outcome.action, outcome.inserted, outcome.deleted) == ("changed", 3, 2)
    assert state(spark, log) == [(1, "a"), (1, "a"), (1, "a"), (2, "b"), (3, None)]
    assert state(spark, log, 1) == [(1, "a"), (2, "b"), (2, "b"), (4, "d")]
    assert R.replicate(third.drop("seen"), log).action == "unchanged"

    wider = third.drop("seen").withColumn("more", F.lit(1))
    assert R.replicate(wider, log).action == "schema-changed"
    assert spark.table(log).columns[:3] == ["id", "name", "more"] and len(state(spark, log)) == 5
    assert state(spark, log + "_to_2", 1) == [(1, "a"), (2, "b"), (2, "b"), (4, "d")]


@pytest.mark.parametrize("per_task", [100_000, 2])
def test_differences_count_copies(spark, monkeypatch, per_task):
    monkeypatch.setattr(R, "COPIES_PER_TASK", per_task)
    rnd = random.Random(per_task)
    rows = [(i, n) for i in range(12) for n in ("a", None)]
    here, there = ([r for r in rows for _ in range(rnd.choice([0, 0, 1, 2, 9]))] for _ in range(2))
    source, dest = (R.with_hash(spark.createDataFrame(x, "id long, name string")) for x in (here, there))
    inserts, deletes = R.changes(source, dest)
    add, gone = Counter(here) - Counter(there), Counter(there) - Counter(here)
    assert Counter((r["id"], r["name"]) for r in inserts.collect()) == add
    assert Counter((r["id"], r["name"]) for r in deletes.collect()) == gone
    after = R.apply_changes(dest, inserts, deletes)
    assert after.columns == dest.columns
    assert Counter((r["id"], r["name"]) for r in after.collect()) == Counter(here)


def test_a_random_history_reads_back(spark, database):
    rnd, log, versions = random.Random(4), f"{database}.h", []
    for _ in range(5):
        rows = [(i, "x") for i in range(8) for _ in range(rnd.choice([0, 1, 1, 3]))]
        R.replicate(spark.createDataFrame(rows, "id long, name string"), log)
        versions.append(sorted(rows))
    assert [state(spark, log, v) for v in range(5)] == versions


def test_a_write_that_was_cut_off_leaves_no_version(spark, database, tmp_path):
    log = f"{database}.t"
    R.replicate(frame(spark, (1, "a")).drop("seen"), log)
    half = spark.table(log).drop("version").withColumn("name", F.lit("half"))
    half.write.parquet(str(tmp_path / "db/t/version=1"))  # files the table does not know
    assert state(spark, log) == [(1, "a")]
    R.replicate(frame(spark, (1, "a"), (2, "b")).drop("seen"), log)
    assert state(spark, log) == [(1, "a"), (2, "b")]


def test_tables_replicate_side_by_side(spark, database):
    tables = {f"{database}.{t}": lambda i=i: frame(spark, (i, "a")).drop("seen") for i, t in enumerate("xyz")}
    tables[f"{database}.lost"] = lambda: spark.read.parquet("/no/such/place")
    done = {o.table.split(".")[1]: o.action for o in R.replicate_all(spark, tables, at_once=3)}
    assert {t: done[t] for t in "xyz"} == dict.fromkeys("xyz", "created") and done["lost"].startswith("failed:")
    assert [state(spark, f"{database}.{t}") for t in "xyz"] == [[(i, "a")] for i in range(3)]


def test_drift(spark):
    rows = frame(spark, (1, "a")).drop("seen")
    assert R.schema_drift(rows, rows.select("name", "id")).count() == 2
    assert R.schema_drift(rows, R.with_hash(rows)).count() == 0


def test_jdbc_options():
    base = jdbc.query_options("jdbc:x", "SELECT 1", user="u")
    assert base == {"url": "jdbc:x", "query": "SELECT 1", "user": "u"}
    split = jdbc.partitioned_options(base, "id", 1, 90, 18)
    assert (split["numPartitions"], split["fetchsize"], split["lowerBound"]) == ("18", "10000", "1")
    assert "query" not in split and split["dbtable"] == "(SELECT 1) strided"
    predicates = jdbc.hash_predicates("hashtext(k)", 3)
    assert len(predicates) == 3 and "IS NULL" in predicates[0] and "IS NULL" not in predicates[1]


# --- registry and allocation


def test_missing_keys_match_missing_keys(spark):
    cities = spark.createDataFrame([("P", None, "C", "R"), ("Q", "K", "D", "S")], "PARISH string, CANTON string, CITY string, REGION string")
    parishes = spark.createDataFrame([("P", None, "id-1")], "PARISH_NAME string, CANTON_NAME string, TRASE_ID string")
    got = {tuple(r) for r in G.city_parish(cities, parishes).collect()}
    assert got == {("id-1", "C", "R", None), (None, "D", "S", "K")}


def test_registry_keeps_the_first_year(spark):
    columns = "CODIGO string, NOMBRE string, DIRECCION_ESTABLECIMIENTO string, TELEFONOS string, CONTACTO string, row_id long"
    first = spark.createDataFrame([("PPA-1", "n\r\nm", "old street", "t", "c", 0), ("2", "x", "s", "t", "c", 1)], columns)
    again = spark.createDataFrame([("PPA-1", "n\r\nm", "new street", "t", "c", 0), ("3", "y", "s", "t", "c", 1)], columns)
    eu = spark.createDataFrame([("PA-2", "EUX", "TOWN", "REG", "PP", "2018")], "CODE string, NAME string, CITY string, REGION string, COMMENT string, YEAR string")
    china = spark.createDataFrame([("1", "CNX", "town", "A")], "APPROVALNO_CLEAN string, NAME string, City_County string, Remark string")
    cities = spark.createDataFrame([("P", "K", "TOWN", "R")], "PARISH string, CANTON string, CITY string, REGION string")
    parishes = spark.createDataFrame([("P", "K", "id-1")], "PARISH_NAME string, CANTON_NAME string, TRASE_ID string")
    registry = G.facility_registry([G.facility_list([first], 1), G.facility_list([again])], eu, china, cities, parishes)
    rows = {r["CODE"]: r for r in registry.collect()}
    assert set(rows) == {"PPA-1", "2", "3"} and duplicates(registry, "CODE").count() == 0
    one = rows["PPA-1"]
    assert (one["ADDRESS"], one["NAME"], one["TYPE"], one["CITY"], one["CANTON"]) == ("old street", "n  m", "F Aq", "TOWN", "K")
    assert (one["EU_CERTIFIED"], one["CHINA_CERTIFIED"], one["CHINA_NAME_SYNONYM"]) == ("FALSE", "TRUE", "CNX")
    assert (rows["2"]["EU_CERTIFIED"], rows["2"]["REGION"], rows["2"]["PARISH_TRASE_ID"]) == ("TRUE", "REG", "id-1")
    assert rows["3"]["CITY"] is None and rows["3"]["SOURCE"].startswith("www.")


def test_allocation(spark):
    ponds = spark.createDataFrame([("p1", "A", "10"), ("p2", "A", "30"), ("p3", None, "60")], "POND_TRASE_ID string, PARISH_TRASE_ID string, AREA_HA string")
    raw = spark.createDataFrame(
        [("2013", "95000", "030616"), ("2013", "5", "999999"), ("2014", "x", "999999")],
        ["YEAR", "TOTAL.Net.Weight..Kg.", "Harmonized.Code.Product.Spanish"],
    )
    flows = A.product_flows(raw)
    per_pond = {(r["POND_TRASE_ID"], r["YEAR"]): r["avg_produced_tons"] for r in A.allocate_by_area(ponds, flows, [2013, 2014]).collect()}
    assert per_pond[("p1", "2013")] == pytest.approx(10.0) and per_pond[("p3", "2014")] == 0
    parish = A.production_per_parish(ponds, flows, [2013, 2014])
    got = {r["YEAR"]: (r["PARISH_TRASE_ID"], r["avg_produced_tons"], r["AREA_HA"]) for r in parish.collect()}
    assert got == {"2013": ("A", pytest.approx(40.0), 40.0), "2014": ("A", 0.0, 40.0)}
    check = {r["YEAR"]: r["covered"] for r in A.allocation_check(parish, flows).collect()}
    assert check == {"2013": False, "2014": True}  # the pond without parish is left out
