"""Runs a query and its SQL on the same tables and compares the rows as sets with counts."""

import datetime
import decimal
import os
from collections import Counter

import duckdb

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}" if v else "0"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


def duck(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def same(spark_df, con, sql):
    names = sorted(spark_df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in spark_df.select(*[f"`{n}`" for n in names]).collect())
    r = con.sql(sql)
    assert sorted(r.columns) == names
    order = [r.columns.index(n) for n in names]
    want = Counter(tuple(plain(row[i]) for i in order) for row in r.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
