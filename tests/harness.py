"""Compares registered queries with the SQL that checks them."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def shown(v: object) -> str:
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return "null"
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(shown(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))
