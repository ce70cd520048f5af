"""Comparing a Spark result with a DuckDB one, rows in any order."""

import datetime
import os

import duckdb
import pandas as pd

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN", "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]"}


def connect(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, (datetime.datetime, datetime.date)):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def assert_same(df, relation):
    got, want = df.collect(), relation.fetchall()
    assert {n: TYPES.get(t, t) for n, t in df.dtypes} == dict(zip(relation.columns, map(str, relation.types)))
    assert rows(df.columns, got) == rows(relation.columns, want)
