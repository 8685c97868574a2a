"""Compares a query with its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def values(pdf: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 9) if isinstance(x, float) else x

    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


def same(df, sql: str, con) -> None:
    got, want = df.toPandas(), con.execute(sql).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)
