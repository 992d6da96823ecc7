"""Every registered query against its SQL statement, run by DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from lodestone.oracles import ORACLES
from lodestone.queries import QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _same(left, right):
    if isinstance(left, float) and isinstance(right, float):
        return math.isclose(left, right, rel_tol=1e-9, abs_tol=1e-9)
    return left == right


def test_entry_holds_every_query_and_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    got = sorted((tuple(row[c] for c in columns) for row in result.collect()), key=repr)
    expected = duck.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(row[i] for i in at) for row in expected.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(_same(x, y) for x, y in zip(a, b)), (a, b)


def test_entry_answers_every_question(spark):
    rows = entry_module.entry(spark).collect()
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert len(rows) == asked == len({r["q_id"] for r in rows})
