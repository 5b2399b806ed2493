"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from locusloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 7) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, sql, name):
    df = QUERIES[name](spark, small)
    found = sql.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_each_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
