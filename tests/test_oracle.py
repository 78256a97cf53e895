"""Every query against its SQL twin on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(spark, con, name):
    problem, _, _ = compare(spark, con, FOLDER, QUERIES[name], SQL[name])
    assert problem is None, problem


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3
