"""Runs a query and its DuckDB SQL on the same tables and compares the rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def normal(frame):
    columns = sorted(frame.columns)
    out = frame[columns].copy()
    for c in columns:
        out[c] = out[c].astype(float).round(6) + 0.0 if out[c].dtype.kind in "fiu" else out[c].astype(str)
    return out.fillna(-9e9).sort_values(columns).reset_index(drop=True)


def assert_same(spark_df, sql, con):
    ours, theirs = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    a, b = normal(ours), normal(theirs)
    assert (a == b).all().all(), (a[(a != b).any(axis=1)].head(), b[(a != b).any(axis=1)].head())
