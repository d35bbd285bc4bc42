"""Folded-in vectors against the fit's own and a plain solve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import retrieval as R
from vitrine.operators.fold_in import fold_in, gram


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(f"c{i % 17}", f"a{(i * i + 3 * (i % 5)) % 23}") for i in range(400)]
    train = spark.createDataFrame(rows, "customer_id string, article_id string")
    users, items = R.fit_retrieval(train, rank=4, iterations=3)
    return train, users.cache(), items.cache()


def vectors(df, key="customer_id"):
    return {r[key]: np.array(r["vec"]) for r in df.collect()}


def test_customers_of_the_fit_get_its_vectors(fitted):
    train, users, items = fitted
    want, got = vectors(users), vectors(fold_in(train, items, 4))
    assert set(got) == set(want)
    assert all(np.allclose(got[c], want[c], atol=2e-3) for c in want)


@pytest.mark.parametrize("bucket_rows", [3, 200_000])
def test_new_customers_equal_a_plain_solve(spark, fitted, bucket_rows):
    _, _, items = fitted
    bought = {"n1": ["a1", "a1", "a4"], "n2": ["a9"], "n3": ["unknown"], "n4": ["a0", "a2", "a3", "a4", "a4", "unknown"]}
    rows = spark.createDataFrame([(c, a) for c, own in bought.items() for a in own], "customer_id string, article_id string")
    y = vectors(items, "article_id")
    shared = sum(np.outer(v, v) for v in y.values())
    assert np.allclose(gram(items, 4), shared)
    want = {}
    for c, own in bought.items():
        own = {a: own.count(a) for a in own if a in y}
        if own:
            left = shared + sum(n * np.outer(y[a], y[a]) for a, n in own.items()) + 0.1 * len(own) * np.eye(4)
            want[c] = np.linalg.solve(left, sum((1 + n) * y[a] for a, n in own.items()))
    got = vectors(fold_in(rows, items, 4, bucket_rows=bucket_rows))
    assert set(got) == set(want) and all(np.allclose(got[c], want[c]) for c in want)
    lists = R.retrieve_topk(fold_in(rows, items, 4), items, 4, 3)
    assert lists.groupBy("customer_id").agg(F.count("*").alias("n")).where("n = 3").count() == 3


def test_empty(spark, fitted):
    train, _, items = fitted
    assert fold_in(train.where("false"), items, 4).count() == 0
    assert fold_in(train, items.where("false"), 4).count() == 0
