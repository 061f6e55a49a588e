"""Rows of Spark and of DuckDB as comparable tuples."""

import os

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str(list(v))
        if v is None or pd.isna(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        try:
            return format(float(v), ".6f") if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def duck(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con.execute(sql).fetchdf()
