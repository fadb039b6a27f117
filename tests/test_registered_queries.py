"""Every registered query against its DuckDB counterpart on the same tables."""

import re

import pytest

import __spark_entry__ as contract
from tests.compare import duckdb_over, duckdb_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
# DuckDB type of each Spark type that results may have.
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return duckdb_over(FOLDER)


# Operators for training data have tests of their own, and SQL only where it can tell them.
QUERIES = {n: q for n, q in contract.queries().items() if n not in contract.LLM_QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_duckdb(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    sql = contract.oracle_sql()[name]
    columns, rows = spark_rows(df)
    expected_columns, expected = duckdb_rows(con, sql)
    assert columns == expected_columns
    assert rows == expected
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == types


def test_every_query_has_a_counterpart():
    assert QUERIES.keys() == contract.oracle_sql().keys() - contract.LLM_SQL.keys()


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_no_query_selects_a_part_of_its_tables():
    for name, sql in contract.oracle_sql().items():
        if name in contract.LLM_SQL:
            continue
        limited = re.search(r"\blimit\b|\bsample\b", sql, re.I)
        assert not limited or name == "top_updated_machines", name
