"""Every query of the catalogue against DuckDB."""

import pytest
from helpers import DATA, against_sql

import __spark_entry__ as entry
from scrutari import catalogue


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query(spark, name):
    mine, theirs = against_sql(spark, catalogue.QUERIES[name], catalogue.SQL[name], f"{DATA}/sf0.001")
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(catalogue.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
