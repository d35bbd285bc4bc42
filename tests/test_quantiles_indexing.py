import hashlib

import numpy as np
import pytest

from vitrine.operators import analytics as A
from vitrine.operators import quantiles as Q
from vitrine.operators.indexing import hashed_index, hashed_running_total

PS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("slices", [2, 64])
@pytest.mark.parametrize("kind", ["uniform", "hot", "few", "one"])
def test_quantiles_match_numpy(spark, monkeypatch, slices, kind):
    monkeypatch.setattr(Q, "SLICES", slices)
    rng = np.random.default_rng(1)
    values = {
        "uniform": rng.normal(size=2000),
        # one value holds a third of all rows
        "hot": np.concatenate([rng.normal(size=1000), np.full(500, 0.25)]),
        "few": rng.integers(0, 4, 301).astype(float),
        "one": np.array([3.5]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = {r.p: r.quantile for r in Q.quantile_rows(df, "v", PS).collect()}
    assert set(got) == set(PS)
    for p in PS:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=101), "b": rng.normal(size=4), "c": np.array([1.0, 1.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("d", None)], "g string, v double")
    got = {(r.g, r.p): r.quantile for r in Q.quantile_rows(df, "v", [0.5, 0.9], by=["g"]).collect()}
    assert {g for g, _ in got} == {"a", "b", "c"}
    for (g, p), v in got.items():
        assert v == pytest.approx(np.quantile(groups[g], p))
    assert Q.quantile_rows(df.limit(0), "v", [0.5]).count() == 0


def test_medians_by_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (9.0, 7.0)], "x double, y double")
    row = Q.column_medians(df, ["x", "y"]).first()
    assert (row.x, row.y) == (2.0, 6.0)


@pytest.mark.parametrize("digits", [1, 3])
def test_index_is_md5_order(spark, digits):
    keys = [f"k{i}" for i in range(300)]
    df = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "k string, g int")
    order = sorted(keys, key=lambda k: hashlib.md5(k.encode()).hexdigest())
    got = {r.k: r.idx for r in hashed_index(df, "k", digits=digits).collect()}
    assert got == {k: i for i, k in enumerate(order)}
    per = hashed_index(df, "k", by=["g"], digits=digits).collect()
    for g in (0, 1):
        assert sorted(r.idx for r in per if r.g == g) == list(range(150))


def test_running_total(spark):
    rows = [(f"k{i}", i + 1) for i in range(200)]
    got = {r.k: r.start for r in hashed_running_total(spark.createDataFrame(rows, "k string, n long"), "k", "n", digits=1).collect()}
    total, n = 0, dict(rows)
    for k in sorted(n, key=lambda k: hashlib.md5(k.encode()).hexdigest()):
        assert got[k] == total
        total += n[k]


def test_describe_histogram_kde(spark):
    values = np.array([1, 2, 2, 3, 10], dtype=float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    stats = {r.stat: r.value for r in A.describe(df, "v").collect()}
    assert stats["std"] == pytest.approx(values.std(ddof=1)) and stats["50%"] == 2.0 and stats["count"] == 5
    hist = {r.bin: r.n for r in A.histogram(df, "v", 3).collect()}
    assert hist == {0: 4, 2: 1}
    assert A.histogram(spark.createDataFrame([(4.0,), (4.0,)], "v double"), "v", 5).collect() == [(0, 2)]
    curve = A.kde(df, "v").toPandas().sort_values("x")
    assert np.trapezoid(curve.density, curve.x) == pytest.approx(1.0, abs=0.01)


def test_shares_and_concentration(spark):
    df = spark.createDataFrame([("a", "x", 3), ("b", "x", 1), ("c", "y", 4), ("d", None, 9)], "article_id string, t string, q long")
    shares = {r.t: r.share_pct for r in A.share_by(df, "t", "q").collect()}
    assert shares == {"x": 50.0, "y": 50.0}
    top = {r.top_n: r.percent for r in A.concentration(df, "q", [1, 2, 10]).collect()}
    assert top[1] == pytest.approx(9 / 17 * 100) and top[10] == pytest.approx(100)
    exact = A.sold_exactly(df.withColumnRenamed("q", "sold_qty"), 1).collect()
    assert [r.article_id for r in exact] == ["b"]


def test_binned_density_is_near_the_exact_one(spark):
    r = np.random.default_rng(6)
    values = np.concatenate([r.normal(0, 1, 400), r.normal(9, 0.2, 300), [40.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    exact = A.kde(df, "v").toPandas().sort_values("point")
    bw = len(values) ** -0.2 * values.std(ddof=1)
    for mesh in (256, 4096):
        binned = A.kde_binned(df, "v", mesh=mesh).toPandas().sort_values("point")
        d = (values.max() - values.min() + 6 * bw) / (mesh - 1) / bw
        assert np.allclose(binned.x, exact.x)
        assert np.abs(binned.density.to_numpy() - exact.density.to_numpy()).max() <= 0.05 * d**2 / bw + 1e-12
