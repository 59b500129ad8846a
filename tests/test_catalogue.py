"""Every catalogue query against its oracle in DuckDB, on the smallest tables that fill a memtable."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from siltlog.plans import catalogue

SF = Path("/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not SF.exists():
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    found = catalogue.QUERIES[name](spark, str(SF))
    columns = sorted(found.columns)
    expected = duck.sql(catalogue.ORACLES[name])
    assert sorted(expected.columns) == columns
    rows = sorted(map(repr, map(tuple, found.select(*columns).collect())))
    assert rows == sorted(map(repr, duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()))
