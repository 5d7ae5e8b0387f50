"""All registered queries against their SQL counterparts on the smallest tables."""

import os

import duckdb
import pytest

from check_queries import rows_of
from discourse_spark.plans import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


# the only result that may be empty on such small tables
MAY_BE_EMPTY = {"dataset_spikes", "nearest_event", "detect_spikes", "proxy_examples"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(answer.columns)
    assert got == rows_of(answer.columns, answer.fetchall())
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
