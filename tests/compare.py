"""Rows of a Spark query against rows of DuckDB SQL."""

import os

import duckdb


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.sql(sql).df()


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
