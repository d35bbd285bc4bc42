"""Enrichment, warm filtering, entity statistics and rolling features."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import clean as C
from vitrine.operators import features as E
from vitrine.operators import unseen as U
from vitrine.operators.mergeable import StatisticsStore
from vitrine.plans.oracle import between, sql
from vitrine.plans.registry import day, money, money_sql, num, num_sql, query, with_nums
from vitrine.session import materialize, run_dir
from vitrine.sources import testdata as T
from vitrine.sources.schemas import (
    ARTICLE_ATTRIBUTES,
    ARTICLE_CATEG,
    CUSTOMER_ATTRIBUTES,
    CUSTOMER_CATEG,
    ROLLING_FEATURES,
)

CUSTOMER_MIN, ARTICLE_MIN = 40, 12


def customers(spark, sf):
    return C.clean_customers(T.raw_customers(spark, sf))


def enriched(spark, sf):
    return E.enrich(T.transactions(spark, sf), customers(spark, sf), T.articles(spark, sf))


def splits(spark, sf):
    return C.split_by_date(T.transactions(spark, sf), T.TRAIN, T.VALIDATION)


def warm(spark, sf, stage=None):
    """Train, test and popularity after the warm filter.

    Only purchases of known customers and articles count. The filter needs nothing but the
    keys, so the attributes are joined to what is left of it.
    """
    train, val = splits(spark, sf)
    return E.warm_filter(train, val, CUSTOMER_MIN, ARTICLE_MIN, T.raw_customers(spark, sf), T.articles(spark, sf), stage)


def with_attributes(spark, sf, tx):
    return E.enrich(tx, customers(spark, sf), T.articles(spark, sf))


def warm_parts(spark, sf):
    """Warm train rows, later rows and the popularity for several consumers: warm keys, popularity and the
    filtered purchases are written once, narrow."""
    train, later, popularity = warm(spark, sf, materialize)
    return materialize(train, "warm_train"), later, popularity


def warm_stage(spark, sf):
    """Enriched warm train rows and the popularity; the attributes are joined on reading."""
    train, _, popularity = warm_parts(spark, sf)
    return with_attributes(spark, sf, train), popularity


_ATTRS = CUSTOMER_ATTRIBUTES + ARTICLE_ATTRIBUTES


@query(
    "enrich_inner",
    sql("enriched", f"SELECT txn_id, age, {', '.join(_ATTRS)} FROM enriched"),
)
def enrich_inner(spark, sf):
    return enriched(spark, sf).select("txn_id", "age", *_ATTRS)


@query(
    "enrich_left",
    sql("transactions customers articles", f"""SELECT txn_id, age, {', '.join(_ATTRS)} FROM transactions
LEFT JOIN (SELECT * FROM customers WHERE FN = '1.0') USING (customer_id) LEFT JOIN articles USING (article_id)"""),
)
def enrich_left(spark, sf):
    """Left enrichment with a customer table that covers only part of the buyers."""
    known = customers(spark, sf).where(F.col("FN") == "1.0")
    out = E.enrich(T.transactions(spark, sf), known, T.articles(spark, sf), "left")
    return out.select("txn_id", "age", *_ATTRS)


@query("warm_transactions", sql("train_customers", "SELECT txn_id FROM train WHERE customer_id IN (SELECT customer_id FROM train_customers)"))
def warm_transactions(spark, sf):
    train, _ = splits(spark, sf)
    keys = E.warm_keys(train, "customer_id", CUSTOMER_MIN)
    return E.keep_keys(train, keys, "customer_id").select("txn_id")


@query(
    "warm_filter_counts",
    sql("warm_train warm_val", """SELECT 'train' AS part, count(*) AS n, count(DISTINCT customer_id) AS customers, count(DISTINCT article_id) AS articles FROM warm_train
UNION ALL SELECT 'test' AS part, count(*) AS n, count(DISTINCT customer_id) AS customers, count(DISTINCT article_id) AS articles FROM warm_val"""),
)
def warm_filter_counts(spark, sf):
    train, test, _ = warm(spark, sf)
    size = lambda df, part: df.agg(
        F.lit(part).alias("part"), F.count("*").alias("n"),
        F.count_distinct("customer_id").alias("customers"), F.count_distinct("article_id").alias("articles"),
    )
    return size(train, "train").unionByName(size(test, "test"))


@query(
    "article_popularity",
    sql("popularity", f"SELECT article_id, n, {num_sql('n / sum(n) OVER () * 1e3')} AS per_mille FROM popularity"),
)
def article_popularity(spark, sf):
    train, _ = splits(spark, sf)
    kept = E.keep_keys(train, E.warm_keys(train, "customer_id", CUSTOMER_MIN), "customer_id")
    pop = E.article_popularity(kept)
    total = pop.agg(F.sum("n")).scalar()
    return pop.withColumn("per_mille", num(F.col("n") / total * 1e3))


@query(
    "unseen_counts",
    sql("transactions articles", """SELECT customer_id, (SELECT count(*) FROM articles) - count(DISTINCT article_id) AS unseen
FROM transactions WHERE article_id IN (SELECT article_id FROM articles) GROUP BY customer_id"""),
)
def unseen_counts(spark, sf):
    return E.unseen_counts(T.transactions(spark, sf), T.articles(spark, sf))


NUMBERED = """numbered AS MATERIALIZED (SELECT article_id, row_number() OVER (ORDER BY md5(article_id), article_id) - 1 AS number FROM (
  SELECT DISTINCT article_id FROM articles))"""


@query(
    "unseen_bitmaps",
    sql("transactions articles", """SELECT customer_id, CAST(number // 512 AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS size,
  count(*) - count(b.article_id) AS unseen, CAST(min(number % 512) FILTER (b.article_id IS NULL) AS INTEGER) AS lowest
FROM (SELECT DISTINCT customer_id FROM transactions) CROSS JOIN numbered
LEFT JOIN (SELECT DISTINCT customer_id, article_id FROM transactions) b USING (customer_id, article_id)
GROUP BY customer_id, number // 512""", NUMBERED),
)
def unseen_bitmaps(spark, sf):
    """Bits of the articles that each customer never bought, by buckets of 512: their number and the lowest."""
    bitmaps = U.unseen_bitmaps(T.transactions(spark, sf), T.articles(spark, sf), bits=512)
    # The first byte that is not zero, then the lowest bit in it.
    zeros = F.length(F.regexp_extract(F.hex("unseen"), "^(?:00)*", 0))
    byte = F.conv(F.substring(F.hex("unseen"), zeros + 1, F.lit(2)), 16, 10).cast("int")
    low = F.log2(byte.bitwiseAND(-byte)).cast("int")
    # Of a bucket that nothing was bought of, the lowest is the first.
    count = F.bitmap_count("unseen")
    lowest = F.when(count == F.col("size"), F.when(count > 0, 0)).when(count > 0, zeros * 4 + low).cast("int")
    return bitmaps.select("customer_id", "bucket", "size", F.bitmap_count("unseen").alias("unseen"), lowest.alias("lowest"))


@query(
    "unseen_pairs",
    sql("transactions articles", """SELECT p.customer_id, p.article_id, b.article_id IS NULL AS unseen FROM (
  SELECT customer_id, CAST((CAST(article_id AS BIGINT) + 1) % (SELECT count(*) FROM articles) AS VARCHAR) AS article_id
  FROM (SELECT DISTINCT customer_id, article_id FROM transactions)) p JOIN articles USING (article_id)
LEFT JOIN (SELECT DISTINCT customer_id, article_id FROM transactions) b USING (customer_id, article_id)"""),
)
def unseen_pairs(spark, sf):
    """Whether the article after each bought one was bought as well, asked of the bitmaps."""
    tx, articles = T.transactions(spark, sf), T.articles(spark, sf)
    catalog = materialize(U.numbered_catalog(articles, 512), "catalog")
    size = catalog.count()
    after = ((F.col("article_id").cast("long") + 1) % size).cast("string").alias("article_id")
    pairs = E.keep_keys(tx.select("customer_id", "article_id").distinct().select("customer_id", after), articles.select("article_id"), "article_id")
    bitmaps = U.unseen_bitmaps(tx, articles, 512, catalog, asked=pairs)
    return U.unseen_pairs(pairs, bitmaps, catalog).select("customer_id", "article_id", "unseen")


def _entity_sql(key, prefix, categ, conti, source):
    parts = ["count(*)::DOUBLE AS {0}_nb_transactions", "count(DISTINCT t_dat)::DOUBLE AS {0}_nb_dates"]
    for c in categ:
        parts.append(f"count(DISTINCT {c})::DOUBLE AS {prefix}_nb_{c}")
        parts.append(f"count(DISTINCT {c}) / count(*) AS {prefix}_ratio_{c}")
    for c in conti:
        parts += [f"min({c}) AS {prefix}_{c}_min", f"max({c}) AS {prefix}_{c}_max",
                  f"avg({c}) AS {prefix}_{c}_mean", f"COALESCE(stddev_samp({c}), 0) AS {prefix}_{c}_std"]
    return f"SELECT {key}, " + ", ".join(parts).format(prefix) + f" FROM {source} GROUP BY {key}"


ART_FEATS_SQL = _entity_sql("article_id", "art", CUSTOMER_CATEG, ["age", "price"], "warm_train")
CUST_FEATS_SQL = _entity_sql("customer_id", "cust", ARTICLE_CATEG, ["price"], "warm_train")


def _rounded(cols):
    return " REPLACE (" + ", ".join(f"{num_sql(c)} AS {c}" for c in cols) + ")"


def feature_names(prefix, categ, conti):
    return (
        [f"{prefix}_nb_transactions", f"{prefix}_nb_dates"]
        + [f"{prefix}_{kind}_{c}" for c in categ for kind in ("nb", "ratio")]
        + [f"{prefix}_{c}_{s}" for c in conti for s in ("min", "max", "mean", "std")]
    )


ART_COLS = feature_names("art", CUSTOMER_CATEG, ["age", "price"])
CUST_COLS = feature_names("cust", ARTICLE_CATEG, ["price"])


@query("article_features", sql("warm_train", f"SELECT *{_rounded(ART_COLS)} FROM ({ART_FEATS_SQL})"))
def article_features(spark, sf):
    train = with_attributes(spark, sf, warm(spark, sf)[0])
    return with_nums(E.article_features(train), ART_COLS)


@query("customer_features", sql("warm_train", f"SELECT *{_rounded(CUST_COLS)} FROM ({CUST_FEATS_SQL})"))
def customer_features(spark, sf):
    train = E.enrich_articles(warm(spark, sf)[0], T.articles(spark, sf))
    return with_nums(E.customer_features(train), CUST_COLS)


def _store(spark, rows, key, prefix, categ, conti, split, **params):
    """Statistics of ``rows``, put in as two arrivals that meet within a month."""
    store = StatisticsStore(spark, run_dir(spark, "statistics"), key, prefix, categ, conti, **params)
    for part in (F.col("t_dat") < F.lit(split).cast("date"), F.col("t_dat") >= F.lit(split).cast("date")):
        store.put(rows.where(part))
    return store


@query("article_features_merged", sql("warm_train", f"SELECT *{_rounded(ART_COLS)} FROM ({ART_FEATS_SQL})"))
def article_features_merged(spark, sf):
    """The statistics of all days, merged; distinct counts are estimates that are exact at this size."""
    train, _ = warm_stage(spark, sf)
    store = _store(spark, train, "article_id", "art", CUSTOMER_CATEG, ["age", "price"], "1998-03-12", unit_days=7)
    return with_nums(store.features(*T.TRAIN), ART_COLS)


SEEN = ("2024-01-05", "2024-01-21")
SEEN_COLS = feature_names("cust", ["article_id"], ["price"])


@query(
    "activity_features_range",
    sql("activity", "SELECT *" + _rounded(SEEN_COLS) + " FROM ("
        + _entity_sql("customer_id", "cust", ["article_id"], ["price"], f"(SELECT * FROM activity WHERE {between(SEEN)})") + ")"),
)
def activity_features_range(spark, sf):
    """The statistics of a range of days that begins and ends within a month."""
    store = _store(spark, T.activity(spark, sf), "customer_id", "cust", ["article_id"], ["price"], "2024-01-11")
    return with_nums(store.features(*SEEN), SEEN_COLS)


MERGED_OUT = ["cust_nb_transactions", "cust_price_mean", "cust_ratio_article_id", "art_nb_transactions", "art_age_mean", "art_price_std"]


@query(
    "merged_features",
    sql("warm_train", f"""SELECT txn_id, {', '.join(f'{num_sql(c)} AS {c}' for c in MERGED_OUT)} FROM warm_train
LEFT JOIN ({CUST_FEATS_SQL}) USING (customer_id) LEFT JOIN ({ART_FEATS_SQL}) USING (article_id)"""),
)
def merged_features(spark, sf):
    train, _ = warm_stage(spark, sf)
    merged = E.merge_features(train, E.customer_features(train), E.article_features(train))
    return merged.select("txn_id", *[num(c).alias(c) for c in MERGED_OUT])


FILL_FROM = "2000-06-01"
_FEATS = CUST_COLS + ART_COLS
_MED = [c for c in _FEATS if c.endswith(("_min", "_max", "_mean"))]
_BEFORE = f"enriched_old AS MATERIALIZED (SELECT * FROM enriched WHERE t_dat < DATE '{FILL_FROM}' AND price > 60000)"
_FILLED_CTE = (
    _BEFORE
    + f""", merged AS MATERIALIZED (SELECT txn_id, c.* EXCLUDE (customer_id), a.* EXCLUDE (article_id) FROM val
 LEFT JOIN ({CUST_FEATS_SQL.replace('warm_train', 'enriched_old')}) c USING (customer_id)
 LEFT JOIN ({ART_FEATS_SQL.replace('warm_train', 'enriched_old')}) a USING (article_id))"""
)


@query(
    "features_filled",
    sql("enriched val", "SELECT txn_id, " + ", ".join(
        f"{num_sql(f'COALESCE({c}, (SELECT median({c}) FROM merged))' if c in _MED else f'COALESCE({c}, 0)')} AS {c}" for c in _FEATS
    ) + " FROM merged", _FILLED_CTE),
)
def features_filled(spark, sf):
    """Validation rows met with features of older, dearer purchases, so that some are missing."""
    everything = enriched(spark, sf)
    old = everything.where((F.col("t_dat") < F.lit(FILL_FROM).cast("date")) & (F.col("price") > 60000))
    _, val = splits(spark, sf)
    merged = E.merge_features(
        val.select("txn_id", "customer_id", "article_id"), E.customer_features(old), E.article_features(old)
    )
    # read twice, for the medians and for the rows
    merged = materialize(merged, "merged")
    return with_nums(E.fill_features(merged), _FEATS).select("txn_id", *_FEATS)


# ---- rolling -------------------------------------------------------------------------

DAILY_SQL = """SELECT customer_id, t_dat, sum(price) AS customer_daily_spend,
 count(DISTINCT article_id) AS customer_daily_articles FROM activity GROUP BY customer_id, t_dat"""
ROLLING_SQL = f"""SELECT *, CASE WHEN count(*) OVER w >= 7 THEN sum(customer_daily_spend) OVER w END AS customer_spend_30d,
 CASE WHEN count(*) OVER w >= 7 THEN CAST(sum(customer_daily_articles) OVER w AS BIGINT) END AS customer_articles_30d
FROM ({DAILY_SQL}) WINDOW w AS (PARTITION BY customer_id ORDER BY t_dat RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)"""
GAP_SQL = """SELECT txn_id, CAST(COALESCE(date_diff('day', lag(t_dat) OVER (PARTITION BY customer_id ORDER BY t_dat, txn_id), t_dat), 0) AS INTEGER)
 AS days_since_last_customer_trans FROM activity"""


@query(
    "daily_activity",
    sql("activity", f"SELECT customer_id, CAST(t_dat AS VARCHAR) AS t_dat, {money_sql('customer_daily_spend')} AS customer_daily_spend, customer_daily_articles FROM ({DAILY_SQL})"),
)
def daily_activity(spark, sf):
    out = E.daily_activity(T.activity(spark, sf))
    return out.withColumns({"t_dat": day(), "customer_daily_spend": money("customer_daily_spend")})


@query(
    "rolling_30d",
    sql("activity", f"SELECT customer_id, CAST(t_dat AS VARCHAR) AS t_dat, {money_sql('customer_spend_30d')} AS customer_spend_30d, customer_articles_30d FROM ({ROLLING_SQL})"),
)
def rolling_30d(spark, sf):
    out = E.rolling_activity(E.daily_activity(T.activity(spark, sf)))
    return out.select("customer_id", day().alias("t_dat"), money("customer_spend_30d").alias("customer_spend_30d"), "customer_articles_30d")


@query("days_since_last", sql("activity", GAP_SQL))
def days_since_last(spark, sf):
    return E.days_since_last(T.activity(spark, sf)).select("txn_id", "days_since_last_customer_trans")


ROLLED = f"""SELECT txn_id, CAST({money_sql('customer_daily_spend')} AS FLOAT) AS customer_daily_spend,
 CAST(customer_daily_articles AS INTEGER) AS customer_daily_articles,
 CAST({money_sql('COALESCE(customer_spend_30d, 0)')} AS FLOAT) AS customer_spend_30d,
 CAST(COALESCE(customer_articles_30d, 0) AS INTEGER) AS customer_articles_30d, days_since_last_customer_trans
FROM activity JOIN ({ROLLING_SQL}) USING (customer_id, t_dat) JOIN ({GAP_SQL}) USING (txn_id)"""


@query("transaction_features", sql("activity", ROLLED))
def transaction_features(spark, sf):
    out = E.transaction_features(T.activity(spark, sf))
    out = out.withColumns({c: money(c) for c in ("customer_daily_spend", "customer_spend_30d")})
    types = {c: "float" if "spend" in c else "int" for c in ROLLING_FEATURES}
    return C.downcast(out, types).select("txn_id", *ROLLING_FEATURES)


LATEST_SQL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, txn_id DESC) AS rn
 FROM transactions) WHERE rn = 1"""


@query("latest_transaction", sql("transactions", f"SELECT customer_id, CAST(t_dat AS VARCHAR) AS t_dat, article_id, txn_id, price FROM ({LATEST_SQL})"))
def latest_transaction(spark, sf):
    out = E.latest_per_customer(T.transactions(spark, sf))
    return out.select("customer_id", day().alias("t_dat"), "article_id", "txn_id", "price")


@query(
    "inference_customers",
    sql("transactions", f"SELECT customer_id, CAST(t_dat AS VARCHAR) AS t_dat, txn_id FROM ({LATEST_SQL}) ORDER BY t_dat, txn_id LIMIT 10"),
)
def inference_customers(spark, sf):
    out = E.limit_customers(E.latest_per_customer(T.transactions(spark, sf)), 10)
    return out.select("customer_id", day().alias("t_dat"), "txn_id")


@query(
    "recent_price_range",
    sql("price_range", "SELECT * FROM price_range"),
)
def recent_price_range(spark, sf):
    return E.recent_price_range(T.transactions(spark, sf))
