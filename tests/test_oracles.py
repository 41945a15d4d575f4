"""Every registered query runs, and agrees with its SQL oracle, on the smallest test tables."""

import os

import pytest

import check_oracles
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, name):
    ok, note = check_oracles.compare(spark, FOLDER, name)
    assert ok, note


def test_entry(spark):
    assert entry(spark).columns == ["h3", "value"]


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
