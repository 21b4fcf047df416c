"""Every registered query against its oracle, on the small tables."""

import os

import pytest

from tessera.queries import ORACLES, QUERIES
from tests import oracle

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    oracle.check(spark, con, name, QUERIES[name], ORACLES[name], SF)
