"""Corpus queries against their SQL, on the smallest given tables."""

import pathlib

import duckdb
import pytest

from siteloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    engine = duckdb.connect()
    for file in pathlib.Path(SF).glob("*.parquet"):
        engine.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = queries.QUERIES[name](spark, SF)
    result = engine.execute(queries.SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in df.columns) for r in df.collect()))) == sorted(
        map(repr, (tuple(r[order.index(c)] for c in df.columns) for r in result.fetchall())))
