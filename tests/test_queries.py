"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from docquarry import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value if isinstance(value, int | str) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    got = found.collect()
    want = duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert [tuple(map(float_close, r)) for r in rows(found.columns, got)] == [tuple(map(float_close, r)) for r in rows(columns, want.fetchall())]


def float_close(x):
    return round(float(x), 5) if isinstance(x, float | int) and not isinstance(x, bool) and math.isfinite(x) else x
