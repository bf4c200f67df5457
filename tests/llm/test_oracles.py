"""Registered queries of the training-data operators against their DuckDB equivalents."""

import os

import duckdb
import pytest

from tallyweave.llm import registry
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    got, want = registry.queries()[name](spark, SF), connection.execute(registry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
