"""Every registered query runs, and gives the rows of its SQL twin where it has one."""

import pytest
from compare import connect, rows
from conftest import SF

from geostrata.plans import registry


@pytest.fixture(scope="module")
def oracle():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        wanted = oracle.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
