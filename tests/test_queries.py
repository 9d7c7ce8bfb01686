"""Every example query against DuckDB on the same tables."""

import pytest
from conftest import FOLDER
from oracle import connect, duck_table, spark_table

import __spark_entry__ as entry
from plumbline.gallery import ALL


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    expected = duck_table(duck, entry.oracle_sql()[name])
    found = spark_table(entry.queries()[name](spark, FOLDER))
    assert found == expected
    assert found[1]


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["entity", "instance", "name", "value"]
    assert found.count() == 12
