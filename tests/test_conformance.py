"""Every registered query against its SQL, and what their plans must not contain."""

from pathlib import Path

import pytest

from conformance.check import connect, duckdb_rows, spark_rows
from conformance.oracle import ORACLE
from conformance.queries import QUERIES
from tests.conftest import plan_of

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    columns, found = spark_rows(frame)
    expected_columns, expected = duckdb_rows(db, ORACLE[name])
    assert columns == expected_columns
    assert found == expected
    plan = plan_of(frame)
    # checks in Python, and the compilation of a table of patterns, are Arrow-batched functions
    in_python = ("validate_python", "validate_rule_table", "match_rule_table")
    python = () if name in in_python else ("EvalPython", "InPandas")
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", *python):
        assert unwanted not in plan


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())
