import pytest

import __spark_entry__
from corpusforge.plans import catalog

from .oracle import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    assert same_rows(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_all_queries_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
