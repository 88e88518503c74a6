"""Compares a query's rows with its DuckDB SQL on the driver's smallest tables."""

import os

import duckdb
import pandas as pd

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (not isinstance(x, (list, str)) and pd.isna(x)):
        return "null"
    if hasattr(x, "year"):
        return str(x)[:10]
    return round(float(x), 6) if hasattr(x, "__float__") else str(x)


def rows(frame):
    ordered = frame[sorted(frame.columns)]
    return list(ordered.columns), sorted((tuple(map(cell, r)) for r in ordered.itertuples(index=False)), key=str)


def same(spark, query, sql):
    with duckdb.connect() as connection:
        for name in TABLES:
            if os.path.exists(f"{SF_DIR}/{name}.parquet"):
                connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
        expected = rows(connection.sql(sql).df())
    assert rows(query(spark, SF_DIR).toPandas()) == expected
