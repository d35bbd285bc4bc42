"""Projection, keys, cleaning, splits, seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions.scalars import image_path, norm_key, season_of
from vitrine.operators import clean as C
from vitrine.plans.oracle import between, sql
from vitrine.plans.registry import money, money_sql, query
from vitrine.sources import testdata as T
from vitrine.sources.schemas import CUSTOMER_CATEG

PROJECTED = ["article_id", "prod_name", "product_type_name", "product_group_name", "colour_group_name", "index_name"]
OPEN_FROM = "2000-06-01"


@query("project_articles", sql("articles", f"SELECT {', '.join(PROJECTED)} FROM articles"))
def project_articles(spark, sf):
    """The SQL form: a view and Spark SQL."""
    T.articles(spark, sf).createOrReplaceTempView("vitrine_articles")
    return spark.sql(f"SELECT {', '.join(PROJECTED)} FROM vitrine_articles")


@query(
    "normalized_keys",
    sql("image_embeddings articles", """SELECT article_id, lpad(article_id, 10, '0') AS padded,
 COALESCE(NULLIF(ltrim(lpad(article_id, 10, '0'), '0'), ''), '0') AS bare FROM articles"""),
)
def normalized_keys(spark, sf):
    padded = T.articles(spark, sf).select("article_id", norm_key("article_id", 10).alias("padded"))
    return padded.withColumn("bare", norm_key("padded"))


@query(
    "customers_clean",
    sql("customers", "SELECT customer_id, FN, Active, club_member_status, fashion_news_frequency, age_interval, postal_code FROM customers"),
)
def customers_clean(spark, sf):
    return C.clean_customers(T.raw_customers(spark, sf)).select(*CUSTOMER_CATEG)


@query("customers_age_imputed", sql("customers", "SELECT customer_id, age FROM customers"))
def customers_age_imputed(spark, sf):
    return C.impute_median(T.raw_customers(spark, sf), "age").select("customer_id", "age")


@query(
    "article_image_paths",
    sql("articles", """SELECT article_id, '/images/' || substr(lpad(article_id, 10, '0'), 1, 3) || '/'
 || lpad(article_id, 10, '0') || '.jpg' AS image_path FROM articles"""),
)
def article_image_paths(spark, sf):
    return T.articles(spark, sf).select("article_id", image_path("article_id").alias("image_path"))


def _sizes(train, val):
    def size(df, part):
        return df.agg(
            F.lit(part).alias("part"), F.count("*").alias("n"), money(F.sum("price")).alias("earning"),
            F.min("t_dat").cast("string").alias("first_day"), F.max("t_dat").cast("string").alias("last_day"),
        )

    return size(train, "train").unionByName(size(val, "val"))


_SIZE = f"count(*) AS n, {money_sql('sum(price)')} AS earning, CAST(min(t_dat) AS VARCHAR) AS first_day, CAST(max(t_dat) AS VARCHAR) AS last_day"


@query(
    "split_counts",
    sql("train val", f"SELECT 'train' AS part, {_SIZE} FROM train UNION ALL SELECT 'val' AS part, {_SIZE} FROM val"),
)
def split_counts(spark, sf):
    return _sizes(*C.split_by_date(T.transactions(spark, sf), T.TRAIN, T.VALIDATION))


@query(
    "split_open_counts",
    sql("transactions", f"""SELECT 'train' AS part, {_SIZE} FROM transactions WHERE {between(T.TRAIN)}
UNION ALL SELECT 'val' AS part, {_SIZE} FROM transactions WHERE t_dat >= DATE '{OPEN_FROM}'"""),
)
def split_open_counts(spark, sf):
    return _sizes(*C.split_by_date(T.transactions(spark, sf), T.TRAIN, (OPEN_FROM, None)))


@query(
    "union_splits",
    sql("train val", """SELECT customer_id, count(*) AS n, CAST(max(t_dat) AS VARCHAR) AS last_day
FROM (SELECT * FROM train UNION ALL SELECT * FROM val) GROUP BY ALL"""),
)
def union_splits(spark, sf):
    train, val = C.split_by_date(T.transactions(spark, sf), T.TRAIN, T.VALIDATION)
    both = train.unionByName(val)
    return both.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.max("t_dat").cast("string").alias("last_day")
    )


@query(
    "sales_by_season",
    sql("transactions", f"""SELECT CASE WHEN month(t_dat) IN (3, 4, 5, 6, 7, 8) THEN 'summer_spring' ELSE 'winter_autumn' END AS season,
 count(*) AS n, {money_sql('sum(price)')} AS earning FROM transactions GROUP BY ALL"""),
)
def sales_by_season(spark, sf):
    tx = T.transactions(spark, sf).withColumn("season", season_of("t_dat"))
    return tx.groupBy("season").agg(F.count("*").alias("n"), money(F.sum("price")).alias("earning"))


@query(
    "articles_seasonal",
    sql("articles season_map", """SELECT article_id, COALESCE(season, 'unknown') AS seasonal_group,
 CAST(COALESCE(season, 'unknown') IN ('summer_spring', 'all_seasons') AS INTEGER) AS is_seasonal
FROM articles LEFT JOIN season_map USING (product_type_name)"""),
)
def articles_seasonal(spark, sf):
    out = C.seasonal_flag(T.articles(spark, sf), T.season_map(spark, sf), F.lit("2001-06-15").cast("date"))
    return out.select("article_id", "seasonal_group", "is_seasonal")
