"""Every named query against its SQL check, on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from assetloom.plans import registry
from tests.compare import differences, duck_connection

SF_DIR = "/root/testdata/sf0.001"
QUERIES, CHECKS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, CHECKS[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_without_check_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(QUERIES) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 5
