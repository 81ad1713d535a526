"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_file
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_file.queries()))
def test_query(spark, duck, name):
    df = entry_file.queries()[name](spark, FOLDER)
    sql = entry_file.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, duck, sql) is None


def test_entry_has_rows(spark):
    assert entry_file.entry(spark).count() == 1
