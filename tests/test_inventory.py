import os

import oracle
import pytest

from spanloom.plans import inventory

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(inventory.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert oracle.table(inventory.QUERIES[name](spark, oracle.DATA).toPandas()) == oracle.table(oracle.connect().execute(inventory.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(inventory.QUERIES) - set(inventory.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert inventory.QUERIES[name](spark, oracle.DATA).count() > 0
