"""Every query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
from aqspark.queries import CATALOG
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(spark, duck, name):
    _, verdict = compare(spark, duck, name, FOLDER)
    assert verdict == "ok"


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
