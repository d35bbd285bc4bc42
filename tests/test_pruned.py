"""Pruned threshold retrieval against all pairs."""

import numpy as np
import pytest

from vitrine.operators import pruned as P
from vitrine.operators import retrieval as R


def frames(spark, users, items):
    put = lambda rows, key, p: spark.createDataFrame([(f"{p}{i:04d}", None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], f"{key} string, vec array<double>")
    return put(users, "customer_id", "u"), put(items, "article_id", "i")


def grouped(n, groups, dim, seed, spread=0.05):
    r = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(groups, dim))
    return [centres[i % groups] + spread * r.normal(size=dim) for i in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("threshold", [0.05, 0.6, 0.95, 0.999999])
@pytest.mark.parametrize("make", ["grouped", "anywhere", "copies"])
def test_same_rows_as_all_pairs(spark, threshold, make):
    r = np.random.default_rng(1)
    if make == "grouped":
        users, items = grouped(90, 6, 8, 1), grouped(120, 6, 8, 2)
    elif make == "anywhere":
        users, items = list(r.normal(size=(60, 8))), list(r.normal(size=(90, 8)))
    else:  # one vector holds most of the rows: its pivot is cut into blocks
        users, items = [np.ones(8)] * 70 + list(r.normal(size=(9, 8))), [np.ones(8) * 2] * 90 + list(r.normal(size=(9, 8)))
    users, items = frames(spark, [*users, None, np.zeros(8)], [*items, None, np.zeros(8)])
    got = P.retrieve_threshold_pruned(users, items, 8, threshold, 3, pivots=5, user_block=16, item_block=16)
    assert rows(got) == rows(R.retrieve_threshold(users, items, 8, threshold, 3))


def test_far_blocks_are_not_met(spark):
    users, items = frames(spark, grouped(300, 10, 16, 3), grouped(300, 10, 16, 4))
    hits, share = P.pruned_hits(users, items, 16, 0.9, pivots=32, user_block=64, item_block=64)
    assert share["met"] <= 0.35 * share["pairs"]
    want = {(u, i) for u, i, score, _ in rows(R.retrieve_threshold(users, items, 16, 0.9, 1)) if score >= 0.9}
    assert {(u, i) for u, i, _ in rows(hits)} == want and want


def test_nothing_to_meet(spark):
    users, items = frames(spark, [np.ones(4)], [None, np.zeros(4)])
    assert rows(P.retrieve_threshold_pruned(users, items, 4, 0.5, 1)) == rows(R.retrieve_threshold(users, items, 4, 0.5, 1))
    assert P.retrieve_threshold_pruned(users.where("false"), items, 4, 0.5, 1).count() == 0
    with pytest.raises(ValueError):
        P.pruned_hits(users, items, 4, 0.0)
