"""Every registered query against its SQL, and the driver contract."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from check_oracle import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(spark, con, SF_DIR, name) is None


def test_sql_only_for_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    rows = contract.entry(spark).collect()
    assert [r["language"] for r in rows][-2:] == ["macro", "micro"]
