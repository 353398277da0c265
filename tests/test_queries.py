"""All registered queries against their SQL twins on the smallest data. A query without a row does not count as equal."""

import pytest

import suite
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(suite.twins()))
def test_query_matches_twin(spark, duck, name):
    status, note = compare(spark, duck, SF, name, suite.twins()[name])
    assert status == "ok", note
