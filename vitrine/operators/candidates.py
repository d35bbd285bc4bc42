"""Candidate lists: the string form, order, feed lookup and business-rule filters.

The working form is long, ``(customer_id, article_id, rank)``; the space-joined string is
only the exchange form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.scalars import norm_key
from vitrine.operators.analytics import facet_rows
from vitrine.operators.clean import display_defaults, seasonal_flag
from vitrine.operators.features import article_prices, recent_price_range
from vitrine.sources.schemas import FACETS

LIST_COL = "predicted_article_ids"
PAGE_SIZE = 18
FEED_CAP = 5000
RESULT_CAP = 2000


def explode_candidates(lists: DataFrame) -> DataFrame:
    """One row per id with its 1-based place; an empty list gives no rows."""
    ids = F.split(F.trim(LIST_COL), r"\s+")
    out = lists.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.posexplode(ids).alias("pos", "article_id"),
    )
    return out.where(F.col("article_id") != "").select(
        "customer_id", "article_id", (F.col("pos") + 1).alias("rank")
    )


def collapse_candidates(cands: DataFrame, order: str = "rank") -> DataFrame:
    """One space-joined string per customer. A list is at most one catalog long."""
    packed = cands.groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "article_id"))).alias("l")
    )
    return packed.select("customer_id", F.array_join("l.article_id", " ").alias(LIST_COL))


def rerank_positions(df: DataFrame, order: list) -> DataFrame:
    """Rank 1, 2, 3 ... per customer in the given order; one customer has at most one catalog."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("customer_id").orderBy(*order)))


def cap(feed: DataFrame, n: int) -> DataFrame:
    return feed.where(F.col("rank") <= n)


def page(df: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) of each customer's list, places counted after filtering."""
    low = (number - 1) * size
    return df.where((F.col("rank") > low) & (F.col("rank") <= low + size))


def page_counts(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.groupBy("customer_id").agg(F.ceil(F.count("*") / size).alias("pages"))


def apply_facets(df: DataFrame, request: dict[str, str], facets: dict[str, str] = FACETS) -> DataFrame:
    """AND of equalities over the known facet keys; empty values and unknown keys do nothing."""
    for key, value in request.items():
        if value and facets.get(key) in df.columns:
            df = df.where(F.col(facets[key]) == value)
    return df


def feed_lookup(feed: DataFrame, articles: DataFrame) -> DataFrame:
    """Feed rows with article details; ids missing from the table stay as null rows."""
    return feed.join(articles, "article_id", "left")


def feed_view(
    feed: DataFrame, articles: DataFrame, request: dict[str, str] | None = None, limit: int = FEED_CAP
) -> tuple[DataFrame, DataFrame]:
    """The displayed rows, and the facet options of the unfiltered feed."""
    details = feed_lookup(cap(feed, limit), articles)
    options = facet_rows(details, FACETS)
    shown = display_defaults(apply_facets(details, request or {}))
    return shown, options


def feed_facet_options(feed: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct facet values per customer feed.

    Rows are dealt by customer before they become a row per facet, so each is moved once and not once a facet.
    """
    details = feed_lookup(feed, articles).select("customer_id", *dict.fromkeys(FACETS.values())).repartition("customer_id")
    cells = F.array(
        *[F.struct(F.lit(k).alias("facet"), F.col(c).alias("value")) for k, c in FACETS.items()]
    )
    long = details.select("customer_id", F.explode(cells).alias("f"))
    return (
        long.select("customer_id", "f.facet", "f.value").where(F.col("value").isNotNull()).distinct()
    )


def price_band(
    cands: DataFrame, tx: DataFrame, ratio: float = 0.2, recent: int = 10, keep_unknown: bool = False
) -> DataFrame:
    """Candidates whose mean price lies within the customer's recent prices, widened by
    ``ratio``. Unknown prices are dropped unless ``keep_unknown``."""
    joined = cands.join(recent_price_range(tx, recent), "customer_id", "left").join(
        article_prices(tx), "article_id", "left"
    )
    inside = (F.col("article_price") >= F.col("min_price") * (1 - ratio)) & (
        F.col("article_price") <= F.col("max_price") * (1 + ratio)
    )
    return joined.where(F.coalesce(inside, F.lit(keep_unknown)))


def availability_flags(articles: DataFrame) -> DataFrame:
    """The flag table the rules expect, with every article available."""
    return articles.select(
        "article_id",
        F.lit(1).alias("is_in_stock"),
        F.lit(1).alias("is_seasonal"),
        F.lit(1).alias("location_available"),
    )


def available(cands: DataFrame, flags: DataFrame) -> DataFrame:
    """Candidates whose three flags are all 1; an article without flags is dropped."""
    good = flags.where(
        (F.col("is_in_stock") == 1)
        & (F.col("is_seasonal") == 1)
        & (F.col("location_available") == 1)
    )
    return cands.join(good.select("article_id"), "article_id", "left_semi")


def filter_candidates(
    cands: DataFrame,
    articles: DataFrame,
    tx: DataFrame,
    ratio: float = 0.2,
    flags: DataFrame | None = None,
    season_map: DataFrame | None = None,
    as_of=None,
    keep_unknown: bool = False,
) -> DataFrame:
    """All business rules with the order kept; ranks are closed up again.

    The season rule is off unless a season map and a day are given.
    """
    flags = availability_flags(articles) if flags is None else flags
    if season_map is not None:
        season = seasonal_flag(articles, season_map, as_of).select("article_id", "is_seasonal")
        flags = flags.drop("is_seasonal").join(season, "article_id")
    kept = price_band(available(cands, flags), tx, ratio, keep_unknown=keep_unknown)
    return rerank_positions(kept.select("customer_id", "article_id", "rank"), ["rank"])


def feed_customers(feed: DataFrame) -> DataFrame:
    return feed.select("customer_id").distinct()


def result_details(results: DataFrame, articles: DataFrame) -> DataFrame:
    """Search results with article columns; the article's own description wins."""
    own = [c for c in articles.columns if c != "article_id"]
    return results.drop(*own).join(articles, "article_id", "left")


def normalized_ids(df: DataFrame, col: str = "article_id") -> DataFrame:
    return df.withColumn(col, norm_key(col))
