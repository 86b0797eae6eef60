"""Run queries next to their SQL in DuckDB: ``python -m tests.oracle_check [name-prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

import __spark_entry__ as entry
from episodica.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return value + 0.0 if value == value else "nan"
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name, sf_dir):
    """Returns (matches, rows, message)."""
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, len(got), "rows only"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, len(got), f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return False, len(got), f"rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return not bad, len(got), f"{len(bad)} differ, e.g. {bad[:2]}" if bad else "ok"


def main(names):
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in entry.queries():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            ok, count, message = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, count, message = False, -1, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={count} {time.time() - start:.1f}s {message if not ok or message != 'ok' else ''}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
