"""Every query with SQL gives the same rows as the SQL; the others run and give rows."""

import pytest

from millrace.plans.catalogue import ORACLES, QUERIES
from tests.compare import DATA, connect, differences

SF = "0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, f"{DATA}/sf{SF}").toPandas()
    if name in ORACLES:
        fault = differences(got, con.execute(ORACLES[name]).df())
        assert fault is None, fault
    else:
        assert len(got) > 0
