"""Every registered query against its SQL on DuckDB, on the smallest data set."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, duck, name):
    problems, _ = compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not problems


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_order_key", "row_price", "row_customer", "row_segment"] and df.count() > 0
