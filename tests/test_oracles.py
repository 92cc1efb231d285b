import os

import oracle
import pytest

from spanloom.plans import nested, reference

QUERIES, ORACLES = nested.QUERIES | reference.QUERIES, nested.ORACLES | reference.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.table(QUERIES[name](spark, oracle.DATA).toPandas()) == oracle.table(con.execute(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).columns == ["session_id", "kind", "start_ms", "end_ms"]
