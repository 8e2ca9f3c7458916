"""Each query against its SQL on the smallest tables, and that none is vacuous."""

import duckdb
import pytest

from tidelog.plans import extraction, queries

QUERIES, SQL = queries.QUERIES | extraction.QUERIES, queries.SQL | extraction.SQL
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in ("documents", "events"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in found.collect())
    assert rows
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        assert rows == sorted(str(tuple(dict(zip(want.columns, r))[c] for c in columns)) for r in want.fetchall())
