"""Rows of a query and of its SQL twin, made comparable."""

import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def rows(frame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return None
        return float(v) + 0.0 if not isinstance(v, (str, bool, bytes)) and type(v).__name__ not in ("bool_", "Timestamp") else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)
