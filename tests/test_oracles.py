"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from areaflow.catalog import registry
from tests.compare import differences, duck

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, sf, con, key):
    got = QUERIES[key](spark, sf).toPandas()
    want = con.execute(ORACLES[key]).fetchdf()
    assert differences(got, want) == []
