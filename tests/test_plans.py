"""The plans the operators are meant to have."""

import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from vitrine.operators import analytics as A
from vitrine.operators import features as E
from vitrine.operators.clean import split_by_date
from vitrine.plans import QUERIES
from vitrine.session import materialize, run_dir
from vitrine.sources import io
from vitrine.sources import testdata as T

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_filter_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["scan_parquet"](spark, SMALL))
    assert "GreaterThanOrEqual(l_extendedprice" in text
    assert "l_shipdate" not in text and "l_comment" not in text


def test_split_bounds_reach_the_scan(spark, tx):
    stored = materialize(tx([("c", "a", d, 1) for d in range(9)]), "tx")
    for df in (stored, stored.withColumn("t_dat", F.col("t_dat").cast("timestamp"))):
        path = materialize(df, "typed")
        text = plan(split_by_date(path, ("2020-01-02", "2020-01-03"), ("2020-01-05", None))[0])
        assert "PushedFilters" in text and "GreaterThanOrEqual(t_dat" in text and "LessThan(t_dat" in text


@needs_tables
def test_only_used_columns_are_read(spark):
    text = plan(A.sold_qty(T.transactions(spark, SMALL)))
    assert "l_extendedprice" not in text and "l_suppkey" not in text and "o_orderdate" not in text


def test_last_rows_are_cut_before_the_shuffle(tx):
    text = plan(E.last_n(tx([("c", "a", 0, 1)]), 10))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_top_n_is_one_ordered_take(tx):
    assert "TakeOrderedAndProject" in plan(A.top_n(A.sold_qty(tx([("c", "a", 0, 1)])), "sold_qty", 100))


@needs_tables
@pytest.mark.parametrize("name", ["unseen_counts", "uniform_negatives", "popularity_negatives", "earning_concentration", "retrieve_topk_blocks", "candidates_filtered"])
def test_no_pairwise_joins(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def _bucketed(spark, tx, name, buckets=4, **params):
    rows = tx([(f"c{i % 23}", f"a{i % 5}", i % 9, i) for i in range(200)])
    return io.write_bucketed(rows, f"{name}_{uuid.uuid4().hex}", run_dir(spark, name), "customer_id", buckets, **params)


def test_bucketed_tables_join_and_group_without_a_shuffle(spark, tx):
    left, right = _bucketed(spark, tx, "left"), _bucketed(spark, tx, "right", files=3)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = left.join(right.select("customer_id", F.col("price").alias("p")), "customer_id")
        counted = joined.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("p").alias("p"))
        text = plan(counted)
        assert "SortMergeJoin" in text and "Exchange" not in text
        plain = tx([(f"c{i % 23}", f"a{i % 5}", i % 9, i) for i in range(200)])
        pairs = plain.join(plain.select("customer_id", F.col("price").alias("p")), "customer_id")
        want = pairs.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("p").alias("p"))
        assert sorted(counted.collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def _buckets_read(spark, df):
    """The plan's own count; it is only told where the scan is kept bucketed."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
    try:
        return re.search(r"SelectedBucketsCount: (\d+ out of \d+)", plan(df.select("*")))[1]
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_one_customer_is_one_bucket(spark, tx):
    table = _bucketed(spark, tx, "lists", buckets=8)
    found = table.where("customer_id = 'c7'")
    assert _buckets_read(spark, found) == "1 out of 8"
    assert found.count() == 9


def test_bucketed_table_opens_by_its_path(spark, tx):
    path, by = run_dir(spark, "kept"), "customer_id"
    rows = tx([(f"c{i % 7}", "a", 0, i) for i in range(50)])
    first = f"t_{uuid.uuid4().hex}"
    io.write_bucketed(rows, first, path, by, 4)
    again = io.open_bucketed(spark, f"t_{uuid.uuid4().hex}", path, rows.schema, by, 4)
    assert sorted(again.collect()) == sorted(rows.collect())
    assert _buckets_read(spark, again.where("customer_id = 'c1'")) == "1 out of 4"


@needs_tables
def test_the_bucketed_query_shuffles_nothing_after_its_tables(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange" not in plan(QUERIES["sink_bucketed"](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_words_are_counted_where_their_text_lies(spark):
    from vitrine.operators import search as S

    docs = materialize(spark.createDataFrame([(f"a{i}", "red coat and blue coat") for i in range(9)], "article_id string, detail_desc string"), "docs")
    text = plan(S.fit_tfidf(docs).weights)
    weights = text[: text.index("BroadcastExchange")] if "BroadcastExchange" in text else text
    assert "hashpartitioning(article_id" in text
    # The vocabulary counts by term; nothing is dealt by article and term, or by article again.
    assert not any("hashpartitioning(article_id" in line and "term" in line for line in text.splitlines())
    assert weights.count("hashpartitioning(article_id") <= 1
