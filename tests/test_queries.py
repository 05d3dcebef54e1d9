"""Every registered query at the smallest scale, against its SQL where it has one."""

import pytest

import __spark_entry__ as registry
from helpers import SF_SMALL
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


def test_registry():
    names, sql = set(registry.queries()), set(registry.oracle_sql())
    assert sql <= names and len(names) > 60


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns[0] == "incident_no" and df.count() > 0


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    ok, message = compare(spark, duck, name, SF_SMALL)
    assert ok, message
