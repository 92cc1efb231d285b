"""Compares queries with their SQL on the smallest tables."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if v is None or v != v or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6f}"
    return str(v)


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(_cell(v) for v in r) for r in df.itertuples(index=False))
