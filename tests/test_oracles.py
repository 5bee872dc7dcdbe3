"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import rows_of_query, rows_of_sql

from loglens.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert rows_of_query(QUERIES[name](spark, SMALL)) == rows_of_sql(SMALL, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
