"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

from tools.check_oracle import compare, connect
from vitrine.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"als_fold_in", "als_retrieval", "knn_lsh", "ranker_boosted", "ranker_fit", "reranked_feed"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, info = compare(spark, con, SMALL, name)
    assert ok, info
