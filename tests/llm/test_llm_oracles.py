import os

import oracle
import pytest

from spanloom.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert oracle.table(queries.QUERIES[name](spark, oracle.DATA).toPandas()) == oracle.table(oracle.connect().execute(queries.ORACLES[name]).df())
