"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(f"{v:.9g}") if abs(v) < 2**53 else v
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(_plain(v)) for v in r) for r in frame.itertuples(index=False))


def assert_same(spark_frame, sql, sf_dir):
    want = connect(sf_dir).execute(sql).df()
    got = spark_frame.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
