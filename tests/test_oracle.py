"""Every registered query against its SQL, on the smallest given tables."""

import math
import pathlib

import duckdb
import pytest

from checks import oracle, registry

SF = "/root/testdata/sf0.001"
SQL = oracle.statements()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for file in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def test_every_query_has_sql():
    assert set(SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, engine, name):
    df = registry.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows
    result = engine.execute(SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert rows == sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in result.fetchall())
