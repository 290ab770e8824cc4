"""Every registered query against its SQL, and the registry's contract."""

import pytest

import __spark_entry__ as entry
from rillflow import catalog
from tests.oracle import SMALL, connect, spark_bag, sql_bag


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert spark_bag(catalog.queries()[name](spark, SMALL)) == sql_bag(con, catalog.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0
