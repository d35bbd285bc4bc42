"""The scoring kernel, the fold-in and the bands against plain sums, and what they move."""

import numpy as np
import pyarrow as pa
import pytest

from vitrine.operators import fold_in as O
from vitrine.operators import pruned as P
from vitrine.operators import retrieval as R
from vitrine.operators import scoring as S
from vitrine.operators import search


def unit(r, n, dim):
    rows = r.normal(size=(n, dim))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def ids(n):
    return pa.array([f"{i:06d}" for i in range(n)])


def emitted(users, items, k, threshold, at_once):
    cuts = [slice(a, a + at_once) for a in range(0, len(items), at_once)]
    blocks = ((ids(len(items))[c], items[c], None) for c in cuts)
    rows = [r for b in S._emit_topk(ids(len(users)), users, blocks, k, threshold) for r in b.to_pylist()]
    return sorted((int(r["customer_id"]), r["hit"], r["place"] if r["hit"] else -round(r["score"], 9), int(r["article_id"])) for r in rows)


@pytest.mark.parametrize("threshold", [None, 0.3, 0.999999999])
@pytest.mark.parametrize("close", [False, True])
def test_single_precision_only_sorts_out(threshold, close):
    r = np.random.default_rng(3)
    users, items = unit(r, 700, 8), unit(r, 1500, 8)
    if close:  # many scores that single precision can't tell apart, and many that are equal
        items = items[0] + 1e-6 * items
        items /= np.linalg.norm(items, axis=1, keepdims=True)
        items[1000:] = items[:500]
        users[:50] = items[:50]
    users[7] = 0
    scores, k = S.pair_scores(users, items), 5
    want = []
    for u, row in enumerate(scores):
        above = np.flatnonzero(row >= round(threshold * S.SCALE)) if threshold else []
        want += [(u, True, p, i) for p, i in enumerate(above, 1)]
        if not len(above):
            want += [(u, False, -round(row[i] / S.SCALE, 9), i) for i in np.lexsort((np.arange(len(row)), -row))[:k]]
    for at_once in (400, 1500):
        assert emitted(users, items, k, threshold, at_once) == sorted(want)


def test_most_products_are_single_precision(monkeypatch):
    r, made, exact = np.random.default_rng(4), [], S._exact
    monkeypatch.setattr(S, "_exact", lambda u, rows, i, cols: made.append(len(rows)) or exact(u, rows, i, cols))
    users, items = unit(r, 300, 32), unit(r, 20_000, 32)
    list(S._emit_topk(ids(300), users, iter([(ids(20_000), items, None)]), 5, None))
    assert 0 < sum(made) < 0.02 * 300 * 20_000


def frame(spark, rows, key):
    return spark.createDataFrame([(k, v.tolist()) for k, v in zip(ids(len(rows)).to_pylist(), rows)], f"{key} string, vec array<float>")


def test_items_are_moved_as_blocks_in_catalog_order(spark):
    r = np.random.default_rng(5)
    items = frame(spark, unit(r, 90, 6), "article_id").unionAll(frame(spark, unit(r, 1, 6), "article_id"))
    packed = S.packed_items(items.selectExpr("*", "1L AS copies"), 6, 16)
    rows = sorted(packed.collect(), key=lambda x: (x["first"], x["last"]))
    assert packed.schema["flat"].dataType.elementType.simpleString() == "float"
    assert [i for x in rows for i in x["ids"]] == ["000000", *ids(90).to_pylist()]
    assert all(len(x["flat"]) == 6 * len(x["ids"]) and len(x["ids"]) <= 16 for x in rows) and len(rows) < 20
    # one band a core
    assert S.bands(5_400_000, 8, 4096, 6, 1) == 6 and S.bands(5_400_000, 8, 4096, 6) == 24


def test_normal_equations_are_plain_sums(monkeypatch):
    r = np.random.default_rng(6)
    monkeypatch.setattr(O, "ROWS_AT_ONCE", 8)
    sizes = [1, 2, 30, 3, 3, 1, 9, 8]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    y, w = r.normal(size=(edges[-1], 4)), r.integers(1, 5, edges[-1]).astype(float)
    left, right = O._normal_equations(y, w, edges)
    for g, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
        assert np.allclose(left[g], (y[s:e].T * w[s:e]) @ y[s:e]) and np.allclose(right[g], (1 + w[s:e]) @ y[s:e])
    # without a single solution the shortest is taken
    assert np.allclose(O._solved(np.zeros((2, 3, 3)), np.zeros((2, 3))), 0)


def test_purchases_without_a_customer_are_left_out(spark):
    bought = spark.createDataFrame([("c", "000000"), ("c", "000001"), (None, "000001")], "customer_id string, article_id string")
    items = frame(spark, unit(np.random.default_rng(2), 4, 3), "article_id")
    assert [r.customer_id for r in O.fold_in(bought, items, 3).collect()] == ["c"]


def test_user_vectors_are_made_once_for_truth_and_scores(spark, monkeypatch):
    from vitrine.plans import retrieval_queries as Q

    users = spark.createDataFrame([("c", [1.0, 0.0])], "customer_id string, vec array<double>")
    items = spark.createDataFrame([("a", [1.0, 1.0]), ("b", None)], "article_id string, vec array<float>")
    val = spark.createDataFrame([("t", "c", "a")], "txn_id string, customer_id string, article_id string")
    kept = []
    monkeypatch.setattr(Q, "materialize", lambda df, name, put=Q.materialize: kept.append(name) or put(df, name))
    monkeypatch.setattr(Q, "splits", lambda *_: (None, val))
    monkeypatch.setattr(Q, "users", lambda *_: users)
    monkeypatch.setattr(Q, "items", lambda *_: items)
    monkeypatch.setattr(Q, "DIM", 2)
    got = Q.softmax_loss(spark, "").first()
    assert kept == ["users"] and got.n == 1 and got.loss == pytest.approx(np.log(np.exp(0.5**0.5) + 1) - 0.5**0.5, abs=1e-6)


def test_hits_of_the_pruned_way_are_not_moved_again(spark, monkeypatch):
    r, kept = np.random.default_rng(7), []
    monkeypatch.setattr(P, "materialize", lambda df, name, put=P.materialize: kept.append(name) or put(df, name))
    users, items = frame(spark, unit(r, 40, 4), "customer_id"), frame(spark, unit(r, 60, 4), "article_id")
    found = P.retrieve_threshold_pruned(users, items, 4, 0.7, 3, pivots=4, user_block=16, item_block=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # only the best of those without a hit are placed by a window
    assert "threshold-hits" not in kept and sum("Window [" in line for line in plan.splitlines()) == 1
    want = R.retrieve_threshold(users, items, 4, 0.7, 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    # a customer that comes twice is placed over both rows
    twice = users.unionAll(users)
    found = P.retrieve_threshold_pruned(twice, items, 4, 0.7, 3, pivots=4, user_block=16, item_block=16)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.retrieve_threshold(twice, items, 4, 0.7, 3).collect()))


def test_a_vector_is_moved_once_for_all_tables(spark):
    r = np.random.default_rng(8)
    emb = frame(spark, unit(r, 80, 5), "article_id").withColumnRenamed("vec", "embedding")
    found = search.knn_lsh(emb.selectExpr("article_id AS query_id", "embedding AS vec"), emb, 5, 3, 0.2, tables=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    exact = search.knn(emb.selectExpr("article_id AS query_id", "embedding AS vec"), emb, 5, 3, 0.2)
    got, want = ({(x.query_id, x.article_id, x.similarity) for x in f.collect()} for f in (found, exact))
    assert len(got & want) >= 0.9 * len(want) and len({(q, a) for q, a, _ in got}) == len(got)
