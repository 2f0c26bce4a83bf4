"""Compares a query with its SQL on DuckDB."""

from __future__ import annotations

import math

import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, np.generic):
        v = v.item()
    return round(v, 6) if isinstance(v, float) else v


def rows(frame):
    """Rows without order, columns by name."""
    found = frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)
    return sorted((tuple(map(_value, r)) for r in found), key=repr)
