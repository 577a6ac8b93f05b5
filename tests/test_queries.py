"""Every registered query of the library against its SQL; queries without SQL must run and keep their columns."""

from __future__ import annotations

import pytest
from conftest import DATA, same_rows

from quarry.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name]))


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
