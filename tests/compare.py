"""Rows of Spark and of DuckDB, as sorted tuples with the columns in order of their names."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, float) else v


def of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def of_duckdb(sql, folder=None, views=None):
    con = duckdb.connect()
    for t in TABLES if folder else []:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, table in (views or {}).items():
        con.register(name, table)
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return [got.columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
