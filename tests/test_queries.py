"""Every query with an SQL twin gives the same rows as DuckDB on the same files."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from boxeval.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(df.columns, df.collect()) == bag(names, cursor.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {name for name in set(entry.queries()) - set(entry.oracle_sql()) if not name.startswith(("op", "pipeline"))}
    assert not own


def test_secret_columns_never_leave_the_safe_projection(spark):
    assert QUERIES["x6_project_safe"](spark, SF).columns == ["vec_id", "label", "exact"]
