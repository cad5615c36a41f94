"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as driver
from leasemill import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(registry.queries()) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equal(spark, duck, name):
    assert differences(driver.queries()[name](spark, SF), duck, driver.oracle_sql()[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
