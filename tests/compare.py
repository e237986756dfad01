"""Rows of a query and of its SQL twin in a comparable form."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def duck(folder: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(folder + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, (float, np.floating)) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(round(float(v), 9) + 0.0) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(_cell(v) for v in r) for r in df.itertuples(index=False))
