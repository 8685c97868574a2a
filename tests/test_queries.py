"""Every query of the case store against its SQL in DuckDB."""

import pytest

from docketry.plans.queries import ORACLES, QUERIES
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    same(QUERIES[name](spark, SF), ORACLES[name], con)
