"""Every registered query against its SQL, over the whole test tables."""

import math
import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from checks.oracles import all_oracles
from checks.queries import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


SQL_TYPES = {
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "int": "INTEGER",
    "string": "VARCHAR",
    "timestamp": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, duck, name):
    found = contract.queries()[name](spark, SF_DIR)
    expected = duck.sql(contract.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    sql_types = dict(zip(expected.columns, map(str, expected.types)))
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in found.schema} == sql_types
    rows = _rows(found.columns, found.collect())
    assert rows == _rows(expected.columns, expected.fetchall())
    assert rows
    # All of it runs inside the JVM, and nothing is paired with everything.
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_oracles()) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship_runs_on_the_smallest_tables(spark):
    assert contract.entry(spark).columns[-1] == "timestamp"
