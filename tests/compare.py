"""Order-insensitive comparison of a Spark query with its SQL in DuckDB."""

import glob
import os

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    plain = lambda x: float(x) if isinstance(x, (float, np.floating)) else x.item() if isinstance(x, np.generic) else x
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False))
