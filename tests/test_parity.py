"""Every registered query against its SQL counterpart on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from docketry.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    ours = sorted(tuple(plain(row[c]) for c in columns) for row in result.collect())
    cursor = duck.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).limit(1).count() == 1


def test_every_query_has_a_counterpart():
    # of the library itself; those in docketry/llm have tests of their own where SQL cannot say the same
    assert set(registry.QUERIES) == set(registry.ORACLES) and set(ORACLES) <= set(QUERIES)
