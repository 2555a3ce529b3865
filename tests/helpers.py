"""Comparison of a query with its SQL, as multisets of rows."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(sql, sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
