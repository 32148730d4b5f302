"""Every query with SQL against DuckDB, over whole small tables."""

import pytest

import __spark_entry__ as e
from oracle import differences, once

D = "/root/testdata/sf0.001"
OUTSIDE = [k for k in e.oracle_sql() if k[:3] not in ("p6_", "p7_", "p8_")]


@pytest.mark.parametrize("name", OUTSIDE)
def test_query_agrees_with_sql(spark, name):
    assert differences(spark, lambda s, d: once(s, e.queries()[name], name, d), e.oracle_sql()[name], D) == ""


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_query_has_sql_or_is_known_to_have_none():
    assert {k for k in e.queries() if k not in e.oracle_sql()} <= {"p6_ids", "p7_found", "p7_shuffled"}
