"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest

from check import compare, oracle_connection
from courtside.plans import ORACLES, QUERIES

SF = os.environ.get("COURTSIDE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, message, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
