"""The retail tables as views of the given star-schema tables.

``vitrine.plans.oracle`` states the same views in ANSI SQL; keep the two together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EMBEDDING_DIM = 64
TRAIN = ("1995-01-01", "2000-12-31")
VALIDATION = ("2001-01-01", "2001-08-01")
CANDIDATES = 50

# Season of each product type of the given tables.
SEASON_OF_TYPE = {
    "anvil": "winter_autumn",
    "bolt": "winter_autumn",
    "gear": "winter_autumn",
    "gizmo": "summer_spring",
    "plate": "summer_spring",
    "ring": "summer_spring",
    "rod": "all_seasons",
}


# Declared, so that no job runs to infer them.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as purchases. ``txn_id`` is unique and settles all ties."""
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return joined.select(
        F.to_date("o_orderdate").alias("t_dat"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_partkey").cast("string").alias("article_id"),
        F.col("l_extendedprice").alias("price"),
        (1 + F.col("o_orderkey") % 2).cast("int").alias("sales_channel_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("txn_id"),
    )


def activity(spark: SparkSession, sf: str) -> DataFrame:
    """User events as a dense transaction table for the rolling features."""
    return table(spark, sf, "events").select(
        F.to_date("ts").alias("t_dat"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("event_type").alias("article_id"),
        F.col("value").alias("price"),
        F.col("event_id").cast("string").alias("txn_id"),
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    word = lambda n: F.element_at(F.split("p_name", " "), n)
    return table(spark, sf, "part").select(
        key.cast("string").alias("article_id"),
        F.col("p_name").alias("prod_name"),
        word(2).alias("product_type_name"),
        F.col("p_type").alias("product_group_name"),
        word(1).alias("colour_group_name"),
        F.col("p_brand").alias("department_name"),
        F.concat(F.lit("Index_"), (size % 5).cast("string")).alias("index_name"),
        F.concat(F.lit("Section_"), (size % 10).cast("string")).alias("section_name"),
        F.concat(F.lit("Garment_"), (key % 7).cast("string")).alias("garment_group_name"),
        F.concat(F.lit("Pattern_"), (key % 4).cast("string")).alias("graphical_appearance_name"),
    )


def described_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with the document of the same number as description, where there is one."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("article_id"), F.col("text").alias("detail_desc")
    )
    return articles(spark, sf).join(docs, "article_id", "left")


def raw_customers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    flag = F.when(key % 3 == 0, "1.0")
    club = (
        F.when(key % 97 == 3, None)
        .when(key % 100 == 2, "LEFT CLUB")
        .when(key % 15 == 1, "PRE-CREATE")
        .otherwise("ACTIVE")
    )
    news = (
        F.when(key % 89 == 5, None)
        .when(key % 101 == 4, "None")
        .when(key % 5 < 2, "Regularly")
        .otherwise("NONE")
    )
    return table(spark, sf, "customer").select(
        key.cast("string").alias("customer_id"),
        flag.alias("FN"),
        flag.alias("Active"),
        club.alias("club_member_status"),
        news.alias("fashion_news_frequency"),
        F.when(key % 50 != 7, (16 + key % 80).cast("double")).alias("age"),
        F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("postal_code"),
    )


def image_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("article_id"), "embedding"
    )


def season_map(spark: SparkSession, sf: str) -> DataFrame:
    """``(product_type_name, season)`` of the mapped product types of the catalog."""
    rule = F.create_map(*[F.lit(x) for kv in SEASON_OF_TYPE.items() for x in kv])
    kinds = articles(spark, sf).select("product_type_name").distinct()
    mapped = kinds.select("product_type_name", rule[F.col("product_type_name")].alias("season"))
    return mapped.where(F.col("season").isNotNull())


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 50 articles per customer in hashed order: ``(customer_id, article_id, rank)``."""
    pairs = transactions(spark, sf).select("customer_id", "article_id").distinct()
    digest = F.md5(F.concat_ws("|", "customer_id", "article_id", F.lit("cand")))
    order = Window.partitionBy("customer_id").orderBy(digest)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= CANDIDATES)
