"""Every registered query that has SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number)):
        return round(float(x), 5) + 0.0
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    duck.execute(SQL[name])
    columns = [c[0] for c in duck.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, duck.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rows_only_queries(spark, sf):
    for name, f in entry.queries().items():
        if name not in SQL and not name.startswith("op") and name != "pipeline":
            assert f(spark, sf).count() > 0, name
