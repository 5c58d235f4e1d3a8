import pytest
from check_sql import compare, connect

import __spark_entry__ as entry
from conftest import SF


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() == 70


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    result, _ = compare(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert result.startswith(("ok", "rows-only")), result
