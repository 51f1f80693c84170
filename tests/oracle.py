"""Runs a query and its SQL on the same tables and compares rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v if not hasattr(v, "quantize") else float(v)


def duck(sql, sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.sql(sql)
    return r.columns, r.fetchall()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def same(df, sql, sf):
    want_cols, want = duck(sql, sf)
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(want_cols), (df.columns, want_cols)
    a, b = rows(df.columns, got), rows(want_cols, want)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y, (x, y)
    return len(a)
