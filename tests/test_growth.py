"""What is moved and held must not grow faster than the rows."""

import re

import pytest
from pyspark.sql import functions as F

from vitrine.operators import candidates as K
from vitrine.operators import evaluate as V
from vitrine.operators import pruned as P
from vitrine.operators import search as S
from vitrine.operators import unseen as U


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(df, word):
    return [line for line in plan(df).splitlines() if word in line]


def test_untouched_buckets_meet_nothing(spark, tx):
    articles = spark.createDataFrame([(f"a{i}",) for i in range(40)], "article_id string")
    maps = U.unseen_bitmaps(tx([("c", "a1", 0, 1), ("d", "none", 0, 1)]), articles, 16)
    assert not any(re.search(r"[ \[]bucket#", line) for line in lines(maps, "Join"))
    assert sorted((r.customer_id, r.bucket, r.size, set_bits(r.unseen)) for r in maps.collect()) == sorted(
        (c, b, s, s - (c == "c" and b == bucket_of(articles))) for c in "cd" for b, s in enumerate([16, 16, 8])
    )


def set_bits(bits):
    return sum(bin(b).count("1") for b in bits)


def bucket_of(articles):
    return U.numbered_catalog(articles, 16).where("article_id = 'a1'").first().bucket


@pytest.mark.parametrize("bits", [64, 72, 512, 1024, 1032])
def test_words_and_bitmaps_are_alike(spark, tx, bits):
    articles = spark.createDataFrame([(f"a{i}",) for i in range(1500)], "article_id string")
    rows = tx([(f"c{i % 3}", f"a{i * 7 % 1500}", 0, 1) for i in range(400)] + [(None, "a1", 0, 1)])
    catalog = U.numbered_catalog(articles, bits)
    seen = U.seen_bitmaps(rows, catalog, bits).select("customer_id", "bucket", F.substring("seen", F.lit(1), F.lit(bits // 8)).alias("seen"))
    want = U.seen_bitmaps(rows, catalog).select("customer_id", "bucket", F.substring("seen", F.lit(1), F.lit(bits // 8)).alias("seen"))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(seen) == order(want)


def test_blocks_are_moved_once_a_band(spark):
    rows = [(f"{i:03d}", [1.0, float(i % 9), float(i % 5)]) for i in range(60)]
    users = spark.createDataFrame(rows, "customer_id string, vec array<double>")
    items = users.withColumnRenamed("customer_id", "article_id")
    hits, share = P.pruned_hits(users, items, 3, 0.1, pivots=4, user_block=4, item_block=4)
    assert share["met"] > 50 and "CoGroup" not in plan(hits)
    unit = [[x / sum(y * y for y in v) ** 0.5 for x in v] for _, v in rows]
    assert hits.count() == sum(round(sum(x * y for x, y in zip(a, b)), 9) >= 0.1 for a in unit for b in unit)


def test_words_are_dealt_into_a_given_number_of_parts(spark):
    docs = spark.createDataFrame([(f"a{i}", "red coat") for i in range(9)], "article_id string, detail_desc string")
    # Parts that are not given by number are put together at run time.
    assert "REPARTITION_BY_NUM" in plan(S.term_counts(docs, "detail_desc"))


def test_facets_are_moved_as_one_row(spark):
    feed = spark.createDataFrame([("c", "a", 1), ("c", "b", 2), ("d", "x", 1), (None, "a", 1)], "customer_id string, article_id string, rank int")
    names = ["product_type_name", "product_group_name", "department_name", "colour_group_name", "graphical_appearance_name"]
    articles = spark.createDataFrame([("a", "t", "g", None, "red", "p"), ("b", "t", "h", None, "red", "q")], "article_id string, " + ", ".join(f"{n} string" for n in names))
    found = K.feed_facet_options(feed, articles)
    assert not any("facet" in line for line in lines(found, "hashpartitioning"))
    values = [("product_type", "t"), ("product_group", "g"), ("colour_group", "red"), ("graphical_appearance", "p")]
    want = [(c, f, v) for c in ("c", None) for f, v in values] + [("c", "product_group", "h"), ("c", "graphical_appearance", "q")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_batches_are_numbered_without_the_customers(spark, tx, monkeypatch):
    seen, number = [], V.with_batches
    monkeypatch.setattr(V, "with_batches", lambda df, key, size: seen.extend(df.columns) or number(df, key, size))
    pairs = tx([("c", "a", 0, 1), ("d", "b", 0, 1), ("none", "a", 0, 1)])
    users = spark.createDataFrame([("c", [1.0, 0.0]), ("d", [0.0, 1.0])], "customer_id string, vec array<double>")
    items = spark.createDataFrame([("a", [1.0, 1.0]), ("b", None)], "article_id string, vec array<double>")
    q = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "article_id string, q double")
    assert V.sampled_softmax_loss(pairs, users, items, q, 2, 8).first().n == 3
    assert "u_vec" not in seen and "i_vec" in seen
