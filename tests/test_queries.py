"""Every registered query next to its SQL on the small tables."""

import os

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


def test_entry(spark):
    assert entry(spark).columns == ["contact", "side", "minutes", "replies"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    sql = oracle_sql().get(name)
    if sql is None:
        df.count()
        return
    assert check.compare(df, duck, sql) is None
