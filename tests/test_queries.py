"""Every registered query against its check SQL, on whole tables."""

import pytest
from check import compare, connect

from claimscope.catalog import CHECKS, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_all_queries_are_checked():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    assert compare(frame, duck, CHECKS[name]) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(CHECKS)
