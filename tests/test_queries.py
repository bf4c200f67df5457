"""Registered queries against their DuckDB equivalents at the smallest scale."""

import os
from collections import Counter

import duckdb
import pytest

from tallyweave.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def database():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, database, name):
    got = registry.queries()[name](spark, SF)
    want = database.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


# titles that the small tables lack, by query
TITLES = {
    "page_identity": ["and&&amp;&amp", "a &quot", "b &gt", "c &am", "d &", "&amp;amp", "&amp;quot;", "A&amp;B &quot;x&quot; 1999"],
    "title_page_scores": ["It.", "Le***", "E.T.", "0", "The title", "title", "tt0000012", "Born in 1999", "+1 (875) 555-1999", "Great reviews", "Ça Details ", "Some - IMDb", "Ç Ç", "a &amp", "TV film"],
}


@pytest.mark.parametrize("name", TITLES)
def test_odd_titles_equal_duckdb(spark, tmp_path, name):
    pages = [(i, f"https://a.org/{i}", f"<html><title>{t}</title></html>") for i, t in enumerate(t for t in TITLES[name] for _ in range(2))]
    spark.createDataFrame(pages + pages[:2], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    database = duckdb.connect()
    database.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got, want = registry.queries()[name](spark, str(tmp_path)), database.execute(registry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
