"""Runs a query and its SQL over the same tables and compares all rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

#: The folder that holds the tables of every scale.
DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(int(v)) if isinstance(v, bool) else repr(v)


def rows_of(names: list[str], rows: list) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted("|".join(cell(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())
