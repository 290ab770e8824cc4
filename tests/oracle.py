"""Comparison of a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os
from collections import Counter

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 7)
    return value


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(row[k]) for k in order) for row in rows)


def spark_bag(df) -> Counter:
    return bag(df.columns, (tuple(r) for r in df.collect()))


def sql_bag(con: duckdb.DuckDBPyConnection, sql: str) -> Counter:
    found = con.execute(sql)
    return bag([c[0] for c in found.description], found.fetchall())
