"""Every registered query against its SQL twin on a second engine."""

import pytest

import __spark_entry__ as driver
from custvoice import queries as catalogue
from tests.compare import connect, duck_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(catalogue.queries()) <= set(driver.queries()) & set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    names, rows = spark_rows(driver.queries()[name](spark, SF_DIR))
    expected_names, expected = duck_rows(duck, driver.oracle_sql()[name])
    assert names == expected_names
    assert rows == expected


def test_entry(spark):
    assert driver.entry(spark).columns == ["final_priority", "n"]
