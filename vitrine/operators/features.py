"""Enrichment joins, warm filtering, entity statistics and rolling customer activity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.scalars import day_number
from vitrine.operators.quantiles import column_medians
from vitrine.sources import schemas


def enrich(
    tx: DataFrame, customers: DataFrame, articles: DataFrame, how: str = "inner"
) -> DataFrame:
    """Transactions with customer and article columns. ``inner`` drops unmatched rows.

    No side is forced to be broadcast: the tables grow with the business, so the runtime
    statistics decide.
    """
    return tx.join(customers, "customer_id", how).join(articles, "article_id", how)


def enrich_articles(tx: DataFrame, articles: DataFrame) -> DataFrame:
    """The article side alone, for features that read no customer column."""
    return tx.join(articles, "article_id")


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def warm_keys(df: DataFrame, key: str, more_than: int) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > more_than).select(key)


def warm_filter(
    train: DataFrame,
    test: DataFrame,
    customer_min: int = 5,
    article_min: int = 10,
    customers: DataFrame | None = None,
    articles: DataFrame | None = None,
    stage: Callable[[DataFrame, str], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers with more than ``customer_min`` train rows, then articles with more than
    ``article_min`` of the remaining rows; one pass of each.

    With ``customers`` and ``articles`` only rows of customers and articles in these tables count. Their
    keys meet the counts, so the rows themselves are met with the warm keys alone. ``stage`` keeps the warm
    customers and the article counts, for callers that read the parts more than once.

    Returns train, test and the article counts taken between the two filters.
    """
    known = lambda df, table, key: df if table is None else keep_keys(df, table.select(key), key)
    stage = stage or (lambda df, name: df)
    counted = warm_keys(known(train, articles, "article_id"), "customer_id", customer_min)
    warm_customers = stage(known(counted, customers, "customer_id"), "warm_customers")
    train_c = keep_keys(train, warm_customers, "customer_id")
    popularity = stage(known(article_popularity(train_c), articles, "article_id"), "popularity")
    warm_articles = popularity.where(F.col("n") > article_min).select("article_id")
    test_c = keep_keys(test, warm_customers, "customer_id")
    return (
        keep_keys(train_c, warm_articles, "article_id"),
        keep_keys(test_c, warm_articles, "article_id"),
        popularity,
    )


def article_popularity(train: DataFrame) -> DataFrame:
    return train.groupBy("article_id").agg(F.count("*").alias("n"))


def unseen_counts(tx: DataFrame, articles: DataFrame) -> DataFrame:
    """How many catalog articles each customer never bought, without listing them."""
    catalog = articles.select("article_id").distinct()
    size = catalog.agg(F.count("*")).scalar()
    bought = (
        tx.select("customer_id", "article_id")
        .distinct()
        .join(catalog.withColumn("known", F.lit(1)), "article_id", "left")
        .groupBy("customer_id")
        .agg(F.count("known").alias("bought"))
    )
    return bought.select("customer_id", (size - F.col("bought")).alias("unseen"))


def entity_features(
    tx: DataFrame, key: str, prefix: str, categ: list[str], conti: list[str], few: list[str] | None = None
) -> DataFrame:
    """Per entity: rows, days, distinct count and ratio of each categorical column, and
    min / max / mean / deviation of each numeric one.

    One aggregate with several exact distinct counts: Spark first shuffles on (key, value),
    which spreads an entity that holds a large part of the rows, and merges partial counts
    per key afterwards. It copies each row once for every such count, so days, which are at most the calendar, and
    columns with ``few`` values, a number that does not grow with the rows, are collected as sets instead, merged
    before the shuffle.
    """
    few = few or []
    rows = f"{prefix}_nb_transactions"
    aggs = [F.count("*").cast("double").alias(rows), F.size(F.collect_set("t_dat")).cast("double").alias(f"{prefix}_nb_dates")]
    kinds = lambda c: F.size(F.collect_set(c)) if c in few else F.count_distinct(c)
    aggs += [kinds(c).cast("double").alias(f"{prefix}_nb_{c}") for c in categ]
    for c in conti:
        aggs += [
            F.min(c).alias(f"{prefix}_{c}_min"),
            F.max(c).alias(f"{prefix}_{c}_max"),
            F.avg(c).alias(f"{prefix}_{c}_mean"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{prefix}_{c}_std"),
        ]
    out = tx.groupBy(key).agg(*aggs)
    return out.withColumns(
        {f"{prefix}_ratio_{c}": F.col(f"{prefix}_nb_{c}") / F.col(rows) for c in categ}
    )


def article_features(tx: DataFrame) -> DataFrame:
    conti = schemas.CUSTOMER_CONTI + schemas.TRANSACTION_CONTI
    return entity_features(tx, "article_id", "art", schemas.CUSTOMER_CATEG, conti, schemas.CUSTOMER_FEW)


def customer_features(tx: DataFrame) -> DataFrame:
    return entity_features(
        tx, "customer_id", "cust", schemas.ARTICLE_CATEG, schemas.TRANSACTION_CONTI, schemas.ARTICLE_ATTRIBUTES
    )


def merge_features(
    tx: DataFrame, customer_feats: DataFrame, article_feats: DataFrame
) -> DataFrame:
    return tx.join(customer_feats, "customer_id", "left").join(article_feats, "article_id", "left")


def fill_features(df: DataFrame) -> DataFrame:
    """Missing min/max/mean feature columns become the median of this frame, others 0."""
    feats = [c for c in df.columns if c.startswith(("cust_", "art_"))]
    by_median = [c for c in feats if c.endswith(("_min", "_max", "_mean"))]
    medians = column_medians(df, by_median).first()
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c])) for c in by_median})
    return filled.fillna(0.0, subset=feats)


# ---- rolling activity -------------------------------------------------------------


def daily_activity(tx: DataFrame) -> DataFrame:
    """Spend and distinct articles per customer and day."""
    return tx.groupBy("customer_id", "t_dat").agg(
        F.sum("price").alias("customer_daily_spend"),
        F.count_distinct("article_id").alias("customer_daily_articles"),
    )


def _by_day():
    return Window.partitionBy("customer_id").orderBy(day_number("t_dat"))


def rolling_activity(
    daily: DataFrame, days: int = 30, min_days: int = 7, exclude_current: bool = False
) -> DataFrame:
    """Sums over the last ``days`` calendar days, null below ``min_days`` active days.

    The window runs over customer days, never over raw rows, so the largest group is the
    length of the calendar however many rows one customer has.
    """
    frame = _by_day()
    ends = (-days, -1) if exclude_current else (-(days - 1), 0)
    w = frame.rangeBetween(*ends)
    enough = F.count("*").over(w) >= min_days
    return daily.withColumns(
        {
            "customer_spend_30d": F.when(enough, F.sum("customer_daily_spend").over(w)),
            "customer_articles_30d": F.when(enough, F.sum("customer_daily_articles").over(w)),
        }
    )


def first_of_day(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_id", "t_dat").agg(F.min("txn_id").alias("first_txn"))


def day_gaps(days: DataFrame) -> DataFrame:
    """Customer days with the days since the customer's previous active day."""
    prev = F.lag("t_dat").over(_by_day())
    return days.withColumn("gap", F.coalesce(F.datediff("t_dat", prev), F.lit(0)))


def _gap_of_row():
    return F.when(F.col("txn_id") == F.col("first_txn"), F.col("gap")).otherwise(0).cast("int")


def days_since_last(tx: DataFrame) -> DataFrame:
    """Days since the customer's previous row; 0 for the first row and later rows of a day."""
    return (
        tx.join(day_gaps(first_of_day(tx)), ["customer_id", "t_dat"], "left")
        .withColumn("days_since_last_customer_trans", _gap_of_row())
        .drop("first_txn", "gap")
    )


def transaction_features(tx: DataFrame, days: int = 30, min_days: int = 7) -> DataFrame:
    """Every transaction with its five rolling features, nulls as 0.

    Daily sums, rolling sums and gaps are all per customer day. The two daily aggregates
    meet on the keys they are already spread by, both windows then share one shuffle by
    customer, and everything reaches the transactions through one join.
    """
    keys = ["customer_id", "t_dat"]
    per_day = daily_activity(tx).join(first_of_day(tx), keys)
    per_day = day_gaps(rolling_activity(per_day, days, min_days))
    joined = tx.join(per_day, ["customer_id", "t_dat"], "left")
    out = joined.withColumn("days_since_last_customer_trans", _gap_of_row()).drop("first_txn", "gap")
    return out.fillna(0, subset=schemas.ROLLING_FEATURES)


def latest_per_customer(tx: DataFrame) -> DataFrame:
    """The last transaction of each customer, ties by transaction key."""
    return last_n(tx, 1)


def last_n(tx: DataFrame, n: int) -> DataFrame:
    """The last ``n`` transactions per customer; only ``n`` rows per task and customer move."""
    w = Window.partitionBy("customer_id").orderBy(F.desc("t_dat"), F.desc("txn_id"))
    return tx.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def limit_customers(latest: DataFrame, n: int | None) -> DataFrame:
    """The ``n`` least recently active customers; all of them by default."""
    return latest if n is None else latest.orderBy("t_dat", "txn_id").limit(n)


def recent_price_range(tx: DataFrame, n: int = 10) -> DataFrame:
    return (
        last_n(tx.select("customer_id", "t_dat", "txn_id", "price"), n)
        .groupBy("customer_id")
        .agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    )


def article_prices(tx: DataFrame) -> DataFrame:
    return tx.groupBy("article_id").agg(F.avg("price").alias("article_price"))
