"""Registered queries beside their SQL in DuckDB, on the same tables."""

import decimal
import os

import duckdb


def value(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if v != v else float(f"{v:.9g}") if abs(v) > 1e-12 else 0.0
    return v


def key(row):
    return tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "", 0 if v is None else v) for v in row)


def connect(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return c


def both(spark, con, folder, query, sql):
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=key)
    ref = con.sql(sql)
    assert sorted(ref.columns) == names
    at = [list(ref.columns).index(c) for c in names]
    theirs = sorted((tuple(value(r[k]) for k in at) for r in ref.fetchall()), key=key)
    return ours, theirs
