"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest
from compare import differences

from marlstone.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    assert differences(catalogue.queries()[name](spark, small), SQL[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0
