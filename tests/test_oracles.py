"""Every registered query that SQL can express gives the SQL's rows."""

import pytest

from corpusloom import catalog
from tests.parity import assert_same, connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, FOLDER), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    rows = catalog.queries()[name](spark, FOLDER).collect()
    assert rows and all(any(x is not None for x in r) for r in rows)


def test_driver_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
