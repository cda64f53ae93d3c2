"""Every query outside llm against its SQL; those without one must at least give rows of a stable schema."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from tessella.queries import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = rows_of(QUERIES[name](spark, data))
    if name in SQL:
        assert got == rows_of_sql(connect(data), SQL[name])


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
