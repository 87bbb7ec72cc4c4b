"""Comparison of a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    got = con.execute(sql)
    return table([d[0] for d in got.description], got.fetchall())
