"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or v is pd.NaT else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> int:
    got = query(spark, sf_dir)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    left, right = _rows(got.columns, got.collect()), _rows(names, cur.fetchall())
    assert len(left) == len(right), (len(left), len(right))
    for a, b in zip(left, right, strict=True):
        assert a == b, (a, b)
    return len(left)
