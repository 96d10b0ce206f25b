"""Every registered query against its check SQL at the smallest scale."""

import pytest

import __spark_entry__ as contract
from workload.check import compare
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert compare(contract.queries()[name](spark, FOLDER), FOLDER, contract.oracle_sql()[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 4
