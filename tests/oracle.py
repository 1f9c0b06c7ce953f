"""Run registered queries beside their SQL and compare the results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, text: str) -> str | None:
    """None when equal, else what differs."""
    got = rows_of(df.columns, df.collect())
    cur = con.execute(text)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: only got {list(set(got) - set(want))[:2]}, only want {list(set(want) - set(got))[:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} != {b}"
    return None


if __name__ == "__main__":
    import os
    import tempfile

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from chaintrail.session import build_session

    sf = sys.argv[1]
    spark = build_session(
        master="local[8]", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="checkpoint-"), "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), entry.oracle_sql()
    wanted = sys.argv[2:]
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                verdict = compare(df, con, sqls[name])
                rows = df.count() if wanted else ""
            else:
                rows, verdict = df.count(), None
            state = "ok" if verdict is None else "DIFF " + verdict
        except Exception as failure:  # noqa: BLE001
            state, rows = f"FAIL {type(failure).__name__} {str(failure)[:600]}", ""
        bad += not state.startswith("ok")
        print(f"{name:32s} {'E' if name in sqls else 'R'} {time.time() - started:6.1f}s {rows} {state}", flush=True)
    print("bad:", bad)
