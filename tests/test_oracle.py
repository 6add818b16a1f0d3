"""Every registered query against its SQL in DuckDB, value by value."""

import pytest

import __spark_entry__ as driver
from tests.conftest import rows
from workloads.queries import ORACLE, QUERIES

PAIRS = sorted(driver.oracle_sql())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(PAIRS)
    assert set(PAIRS) <= set(driver.queries())


@pytest.mark.parametrize("name", PAIRS)
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = driver.queries()[name](spark, sf_dir)
    expected = duck.execute(driver.oracle_sql()[name])
    names = [column[0] for column in expected.description]
    assert sorted(found.columns) == sorted(names)
    wanted = sorted((tuple(row) for row in expected.fetchall()), key=repr)
    assert list(map(repr, rows(found.select(*[f"`{name}`" for name in names])))) == list(map(repr, wanted))


def test_entry(spark, sf_dir):
    assert driver.entry(spark).count() == 1
