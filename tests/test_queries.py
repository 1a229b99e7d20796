"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in oracle_sql():
        assert compare(df, rows, con.sql(oracle_sql()[name])) == []


def test_entry(spark):
    rows = {r["split"]: r for r in entry(spark).collect()}
    assert set(rows) == {"train", "test"}
    assert rows["train"]["examples"] > rows["test"]["examples"] > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
