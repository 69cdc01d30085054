"""Compares a query with its SQL on the driver's tables."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.01"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return str(v) if not isinstance(v, (int, str, type(None))) else v


def check(spark, queries, sql, name, sf=SF):
    df = queries[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=repr)
    if name not in sql:
        return got
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    rel = con.sql(sql[name])
    assert sorted(rel.columns) == names
    order = [rel.columns.index(n) for n in names]
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want
    return got
