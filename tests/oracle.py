"""Comparison of a query with its SQL on the same tables."""

import glob
import math
import os

import duckdb


def tables(directory):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def assert_same(spark_rows, columns, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    order = [names.index(c) for c in sorted(columns)]
    want = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    at = [columns.index(c) for c in sorted(columns)]
    have = sorted(tuple(plain(r[i]) for i in at) for r in spark_rows)
    assert have == want
