"""Every registered archive query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from colloquy.plans import registered as queries

SF = "/root/testdata/sf0.001"
TABLES = "events documents orders conversations labels pages".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or pd.isna(x):
            return "null"
        return repr(round(float(x), 9)) if isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    wanted = duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).columns
