"""Every query with SQL gives the same rows as the SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    engine = duckdb.connect()
    engine.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        engine.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return engine


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    cursor = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns
