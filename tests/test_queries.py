"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES = {name: query for plan in entry.PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in entry.PLANS for name, sql in plan.ORACLES.items()}


@pytest.fixture(scope="module")
def db(sf):
    held = duckdb.connect()
    for name in TABLES.split():
        held.sql(f"CREATE VIEW {name} AS FROM '{sf}/{name}.parquet'")
    return held


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        rows = db.sql(ORACLES[name])
        at = [rows.columns.index(c) for c in columns]
        assert found == sorted(tuple(str(r[i]) for i in at) for r in rows.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
