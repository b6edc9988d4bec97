"""Compares a query with its DuckDB counterpart on the same Parquet files."""

import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or str(value) in ("<NA>", "NaT"):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else float(value)
    if isinstance(value, (bool, int, np.bool_, np.integer)):
        return float(value)
    return str(value)


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


def counterpart(sql: str, sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection.sql(sql).df()


def agree(df, sql: str, sf_dir: str) -> None:
    ours, theirs = df.toPandas(), counterpart(sql, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
