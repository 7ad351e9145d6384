"""Runs a query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb
import pandas as pd


def oracle(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return connection


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.4f}"
    if isinstance(value, pd.Timestamp) or hasattr(value, "isoformat"):
        return str(value)[:10]
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False)), key=str)


def same(query, sql: str, spark, sf_dir: str) -> str:
    """'' if both give the same rows, else what differs."""
    got = query(spark, sf_dir).toPandas()
    want = oracle(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return ""
    left, right = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} / {len(b)} rows; only here {left}; only there {right}"
