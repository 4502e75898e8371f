"""Registered queries against their SQL."""

import pytest
from oracle import compare

from deltaloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1146
    assert set(entry.oracle_sql()) <= set(entry.queries())
