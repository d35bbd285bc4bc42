"""Rows stay narrow and unmoved until keys and draws are settled."""

import datetime as dt

from pyspark.sql import functions as F

from vitrine.operators import encode as N
from vitrine.operators import features as E
from vitrine.operators import negatives as G
from vitrine.sources import schemas


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ordered(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def frames(spark, tx):
    df = tx([(c, a, i % 3, i + 1) for i, (c, a) in enumerate([("c", "a"), ("c", "b"), ("d", "a"), ("c", "a"), ("d", "c")])])
    df = df.unionByName(df.where(F.col("article_id") == "b"))
    customers = spark.createDataFrame([("c", 30.0), ("d", None), ("d", 41.0)], "customer_id string, age double")
    articles = spark.createDataFrame([("a", "hat"), ("b", None), ("b", "cap"), ("c", "bag")], "article_id string, prod string")
    feats = spark.createDataFrame([("a", 1.5), ("b", None)], "article_id string, art_x double")
    cust = spark.createDataFrame([("c", 7.0)], "customer_id string, cust_x double")
    return df, customers, articles, feats, cust


def test_bare_and_wide_training_rows_are_alike(spark, tx):
    """Repeated keys on either side, missing attributes and missing features."""
    df, customers, articles, feats, cust = frames(spark, tx)
    popularity = E.article_popularity(df)
    wide = E.merge_features(E.enrich(df, customers, articles), cust, feats)
    cols = ["age", "cust_x"]
    want = G.training_set(wide, popularity, articles, feats, cols, n=3)
    known = customers.join(cust, "customer_id", "left")
    got = G.training_set(df, popularity, articles, feats, cols, n=3, customers=known)
    assert ordered(got) == ordered(want) and got.count() > df.count() * 4


def test_articles_are_drawn_for_bare_keys(spark, tx):
    df, customers, articles, feats, cust = frames(spark, tx)
    known = customers.join(cust, "customer_id", "left")
    out = G.training_set(df, E.article_popularity(df), articles, feats, ["age", "cust_x"], customers=known)
    sliced = [line for line in plan(out).splitlines() if "hashpartitioning(slice" in line]
    assert sliced and "age" not in plan(out).split("hashpartitioning(slice")[1].split("Exchange")[0]


def test_days_are_not_copied_as_distinct_values(spark, tx):
    """Days are at most the calendar: with them as a set, the customers' only distinct count copies no row."""
    df = tx([("c", "a", 0, 1), ("c", "a", 0, 2), ("c", "b", 4, 3), ("d", "a", 1, 4)])
    df = df.withColumn("t_dat", F.when(F.col("price") < 4, F.col("t_dat")))
    for name in schemas.ARTICLE_ATTRIBUTES:
        df = df.withColumn(name, F.lit("x"))
    out = E.customer_features(df)
    assert "Expand" not in plan(out)
    days = {r.customer_id: (r.cust_nb_dates, r.cust_nb_article_id, r.cust_nb_transactions) for r in out.collect()}
    assert days == {"c": (2.0, 2.0, 3.0), "d": (0.0, 1.0, 1.0)}


def test_known_keys_meet_the_counts(spark, tx):
    """The same as counting rows of known customers and articles, without a join of the rows for each table."""
    rows = [("c", "a", i, 1) for i in range(3)] + [("c", "x", 9, 1), ("d", "a", 1, 1), ("d", "x", 1, 1), ("d", "x", 2, 1)]
    rows += [("n", "a", i, 1) for i in range(5)] + [(None, "a", 1, 1), ("c", None, 2, 1), ("e", "b", 1, 1), ("e", "b", 2, 1), ("e", "b", 3, 1)]
    train = tx(rows)
    test = tx([("c", "a", 50, 1), ("d", "a", 50, 1), ("n", "a", 50, 1), ("e", "x", 50, 1), ("e", "b", 50, 1)])
    customers = spark.createDataFrame([("c",), ("d",), ("e",), ("e",), (None,)], "customer_id string")
    articles = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "article_id string")
    known = lambda df: E.keep_keys(E.keep_keys(df, customers, "customer_id"), articles, "article_id")
    want = E.warm_filter(known(train), known(test), 2, 2)
    staged = []
    got = E.warm_filter(train, test, 2, 2, customers, articles, lambda df, name: staged.append(name) or df)
    assert [ordered(df) for df in got] == [ordered(df) for df in want]
    assert {r.customer_id for r in got[0].collect()} == {"c", "e"} and staged == ["warm_customers", "popularity"]
    assert plan(got[0].where(F.col("t_dat") > dt.date(1999, 1, 1))).count("LeftSemi") < plan(want[0].where(F.col("t_dat") > dt.date(1999, 1, 1))).count("LeftSemi")


def test_many_columns_are_normalised_in_compiled_passes(spark, monkeypatch):
    """An aggregate of 100 fields or more is not compiled; the numbers are those of one pass."""
    cols = [f"x{i}" for i in range(40)]
    df = spark.createDataFrame([(float(i), None if i == 1 else 2.0) for i in range(5)], "a double, b double")
    df = df.select(*[F.col("a" if i % 2 else "b").alias(c) for i, c in enumerate(cols)])
    seen = []
    monkeypatch.setattr(type(df), "agg", lambda self, *aggs, f=type(df).agg: seen.append(len(aggs)) or f(self, *aggs))
    fitted = N.fit_normalizer(df, cols)
    assert list(fitted) == cols and fitted["x1"] == (2.0, 2.0) and fitted["x38"] == (2.0, 0.0)
    # mean and variance hold five fields a column
    assert max(seen) // 2 * 5 < 100 and N.fit_normalizer(df, []) == {}
