"""Run registered queries and their DuckDB form on one data folder and compare the rows.

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import logging
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, sf_dir, query, sql):
    """(equal, message, rows, spark seconds, duckdb seconds)"""
    t = time.time()
    return compare_df(con, query(spark, sf_dir), sql, t)


def compare_df(con, df, sql, t):
    got = df.collect()
    t_spark = time.time() - t
    if sql is None:
        return True, "rows only", len(got), t_spark, 0.0
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t_duck = time.time() - t
    a_cols, a = rows_of(df.columns, [tuple(r) for r in got])
    b_cols, b = rows_of(names, want)
    if a_cols != b_cols:
        return False, f"columns {a_cols} != {b_cols}", len(a), t_spark, t_duck
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return False, f"{len(a)} vs {len(b)} rows; first difference: {diff}", len(a), t_spark, t_duck
    return True, "", len(a), t_spark, t_duck


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from plumbline.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    spark = build_session("compare", f"local[{os.cpu_count()}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = duck(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            ok, message, n, ts, td = compare(spark, con, sf_dir, query, oracle.get(name))
        except Exception as e:
            ok, message, n, ts, td = False, f"{type(e).__name__}: {str(e)[:1500]}", 0, 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} rows={n:<7d} spark={ts:6.2f}s duckdb={td:6.2f}s {message}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
