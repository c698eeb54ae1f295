"""Spark query against DuckDB SQL on the same tables: columns sorted by name, rows as sorted tuples."""

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if glob.glob(path):
            con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime) and v.tzinfo:
        v = v.astimezone(datetime.UTC).replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def kinds(data):
    return [sorted({type(x).__name__ for x in col if x is not None}) for col in zip(*data, strict=True)]


def difference(spark, con, query, sql, sf):
    """None if both give the same, else what differs first."""
    df = query(spark, sf)
    a_names, a = rows(df.columns, df.collect())
    rel = con.sql(sql)
    b_names, b = rows(rel.columns, rel.fetchall())
    if a_names != b_names:
        return f"columns {a_names} / {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    if kinds(a) != kinds(b):
        return f"types {kinds(a)} / {kinds(b)} of {a_names}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad and sum(any(p != q and not (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1.01e-4) for p, q in zip(x, y, strict=True)) for x, y in bad) == 0:
        return f"rounding only: {len(bad)} {bad[0]}"
    return f"{len(bad)} rows differ {a_names}: {bad[0][0]} / {bad[0][1]}" if bad else None
