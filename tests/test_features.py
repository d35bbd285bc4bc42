import numpy as np
import pandas as pd
import pytest

from vitrine.operators import features as E


def test_thirty_day_window_and_minimum(tx):
    df = tx([("c", "a", d, 1) for d in (0, 1, 2, 3, 4, 5, 29, 30, 59)])
    rows = E.rolling_activity(E.daily_activity(df)).orderBy("t_dat").collect()
    # seven active days are first inside (t-30, t] on day 29; on day 30 day 0 has left
    assert [r.customer_spend_30d for r in rows] == [None] * 6 + [7.0, 7.0, None]


def test_rolling_matches_pandas(tx):
    rng = np.random.default_rng(3)
    rows = [(f"c{rng.integers(4)}", f"a{rng.integers(6)}", int(rng.integers(70)), int(rng.integers(1, 50))) for _ in range(600)]
    df = tx(rows)
    got = E.rolling_activity(E.daily_activity(df)).toPandas()
    pdf = df.toPandas()
    pdf["t_dat"] = pd.to_datetime(pdf.t_dat)
    daily = pdf.groupby(["customer_id", "t_dat"]).agg(s=("price", "sum"), n=("article_id", "nunique")).reset_index()
    want = daily.set_index("t_dat").groupby("customer_id")[["s", "n"]].rolling("30D", min_periods=7).sum().reset_index()
    got["t_dat"] = pd.to_datetime(got.t_dat)
    both = got.merge(want, on=["customer_id", "t_dat"])
    assert len(both) == len(daily)
    assert np.allclose(both.customer_spend_30d.astype(float), both.s, equal_nan=True)
    assert np.allclose(both.customer_articles_30d.astype(float), both.n, equal_nan=True)
    leak_free = E.rolling_activity(E.daily_activity(df), min_days=1, exclude_current=True)
    assert leak_free.where("customer_spend_30d IS NULL").count() >= 4


def test_day_gap_only_on_first_row_of_a_day(tx):
    df = tx([("c", "a", 0, 1), ("c", "b", 0, 1), ("c", "a", 3, 1), ("c", "b", 3, 1), ("c", "a", 4, 1), ("d", "a", 9, 1)])
    got = [r.days_since_last_customer_trans for r in E.days_since_last(df).orderBy("txn_id").collect()]
    assert got == [0, 0, 3, 0, 1, 0]
    full = E.transaction_features(df).orderBy("txn_id").collect()
    assert [r.days_since_last_customer_trans for r in full] == got
    assert all(r.customer_spend_30d == 0 for r in full)


def test_entity_features_single_sale_has_no_deviation(spark, tx):
    df = tx([("c1", "a", 0, 5), ("c1", "b", 1, 7), ("c2", "b", 1, 9)])
    feats = {r.article_id: r for r in E.entity_features(df, "article_id", "art", ["customer_id"], ["price"]).collect()}
    assert feats["a"].art_price_std == 0.0 and feats["a"].art_ratio_customer_id == 1.0
    assert feats["b"].art_nb_transactions == 2.0 and feats["b"].art_nb_dates == 1.0
    assert feats["b"].art_price_std == pytest.approx(np.std([7, 9], ddof=1))


def test_warm_filter_is_sequential_and_single_pass(tx):
    train = tx([("c1", "a", 0, 1)] * 3 + [("c1", "b", 0, 1)] + [("c2", "b", 0, 1)] * 2)
    test = tx([("c1", "a", 9, 1), ("c1", "b", 9, 1), ("c2", "a", 9, 1), ("c3", "a", 9, 1)])
    kept, kept_test, pop = E.warm_filter(train, test, 2, 1)
    assert {tuple(r) for r in pop.collect()} == {("a", 3), ("b", 1)}
    assert kept.count() == 3 and kept.select("article_id").distinct().collect() == [("a",)]
    assert [(r.customer_id, r.article_id) for r in kept_test.collect()] == [("c1", "a")]


def test_fill_uses_medians_of_the_frame(spark):
    df = spark.createDataFrame(
        [("t1", 1.0, 2.0), ("t2", 3.0, None), ("t3", None, 4.0)], "txn_id string, cust_price_mean double, art_nb_dates double"
    )
    got = {r.txn_id: r for r in E.fill_features(df).collect()}
    assert got["t3"].cust_price_mean == 2.0 and got["t2"].art_nb_dates == 0.0


def test_latest_recent_prices_and_unseen(spark, tx):
    rows = [("c", f"a{i}", i, i) for i in range(12)] + [("d", "a0", 0, 5)]
    df = tx(rows)
    assert {r.customer_id: r.article_id for r in E.latest_per_customer(df).collect()} == {"c": "a11", "d": "a0"}
    ranges = {r.customer_id: (r.min_price, r.max_price) for r in E.recent_price_range(df).collect()}
    assert ranges == {"c": (2.0, 11.0), "d": (5.0, 5.0)}
    arts = spark.createDataFrame([(f"a{i}",) for i in range(15)], "article_id string")
    assert {r.customer_id: r.unseen for r in E.unseen_counts(df, arts).collect()} == {"c": 3, "d": 14}
    assert E.limit_customers(E.latest_per_customer(df), 1).first().customer_id == "d"


def test_enrichment_drops_or_keeps(spark, tx):
    df = tx([("c1", "a", 0, 1), ("c9", "a", 0, 1), ("c1", "z", 0, 1)])
    cust = spark.createDataFrame([("c1", 30)], "customer_id string, age int")
    art = spark.createDataFrame([("a", "Top")], "article_id string, kind string")
    assert E.enrich(df, cust, art).count() == 1
    assert E.enrich(df, cust, art, "left").count() == 3


def test_empty_input_keeps_schema(tx):
    none = tx([("c", "a", 0, 1)]).limit(0)
    for op in (E.transaction_features, E.days_since_last, E.latest_per_customer, E.recent_price_range, E.article_prices):
        out = op(none)
        assert out.count() == 0 and out.columns
