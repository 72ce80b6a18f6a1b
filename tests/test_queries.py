"""Every registered query against its SQL, and the driver's contract."""

import pytest

import __spark_entry__ as driver
from oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.PLAIN_QUERIES, driver.PLAIN_ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    wrong = difference(spark, con, SF_DIR, QUERIES[name], ORACLES[name])
    assert wrong is None, wrong


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_plain_query_has_sql():
    assert set(driver.PLAIN_QUERIES) == set(driver.PLAIN_ORACLES)
