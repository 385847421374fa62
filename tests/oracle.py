"""Compares a query with its SQL the way the driver does: columns by name, rows as a multiset."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def sql_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con.execute(sql).df()


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, pd.Timestamp):
            return x.to_pydatetime().replace(tzinfo=None)
        if hasattr(x, "item"):
            x = x.item()
        return round(x, 6) + 0.0 if isinstance(x, float) else x

    rows = [tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if they agree, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(canonical(got), canonical(want), strict=True):
        if a != b and not all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return None
