"""Every registered query of the recordings against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from episodica.plans.all_queries import QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ok, _, message = compare(spark, duck, name, SF)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
