"""Scans, sinks, stages and the streaming refresh, checked by reading back what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.operators.features import recent_price_range
from vitrine.plans.feature_queries import ROLLED, splits
from vitrine.plans.oracle import between, sql
from vitrine.plans.registry import day, money, money_sql, query
from vitrine.session import run_dir
from vitrine.sources import io, schemas
from vitrine.sources import testdata as T
from vitrine.streaming.refresh import refresh_stream

_TX = ["t_dat", "customer_id", "article_id", "price", "sales_channel_id"]


@query(
    "scan_csv",
    sql("transactions", f"""SELECT CAST(t_dat AS VARCHAR) AS t_dat, customer_id, article_id, price FROM transactions
WHERE t_dat >= DATE '{T.VALIDATION[0]}'"""),
)
def scan_csv(spark, sf):
    """CSV round trip with declared types, chosen columns and a lower date bound."""
    path = run_dir(spark, "csv")
    io.write_csv(T.transactions(spark, sf).select(*_TX), path)
    out = io.read_transactions(spark, path, ["t_dat", "customer_id", "article_id", "price"], since=T.VALIDATION[0])
    return out.withColumn("t_dat", day())


@query(
    "scan_parquet",
    """SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice >= 50000.0""",
)
def scan_parquet(spark, sf):
    """Column pruning and a filter that reaches the scan."""
    scan = io.read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_extendedprice"])
    return scan.where(F.col("l_extendedprice") >= 50000.0)


@query(
    "sink_parquet",
    sql("transactions", f"""SELECT sales_channel_id, customer_id, count(*) AS n, {money_sql('sum(price)')} AS earning
FROM transactions GROUP BY sales_channel_id, customer_id"""),
)
def sink_parquet(spark, sf):
    """Partitioned write and read back."""
    path = run_dir(spark, "parquet")
    io.write_table(T.transactions(spark, sf).select(*_TX), path, ["sales_channel_id"])
    back = io.read_table(spark, path)
    return back.groupBy("sales_channel_id", "customer_id").agg(
        F.count("*").alias("n"), money(F.sum("price")).alias("earning")
    )


def _bucketed(spark, sf, buckets=16):
    """Recent price ranges and candidate lists as two tables bucketed by customer."""
    name = lambda what: f"{what}_{uuid.uuid4().hex}"
    ranges = recent_price_range(T.transactions(spark, sf))
    lists = T.candidates(spark, sf)
    return tuple(
        io.write_bucketed(df, name(what), run_dir(spark, what), "customer_id", buckets)
        for df, what in ((ranges, "ranges"), (lists, "lists"))
    )


@query(
    "sink_bucketed",
    sql("candidates price_range", """SELECT customer_id, count(*) AS n, min(rank) AS first, max(rank) AS last,
 min(min_price) AS min_price, max(max_price) AS max_price
FROM candidates JOIN price_range USING (customer_id) GROUP BY customer_id"""),
)
def sink_bucketed(spark, sf):
    """Features met with lists, and lists counted, inside the buckets both tables share."""
    ranges, lists = _bucketed(spark, sf)
    return lists.join(ranges, "customer_id").groupBy("customer_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"),
        F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
    )


@query("sink_json", sql("described", "SELECT article_id, detail_desc, CAST(article_id AS DOUBLE) / 8 AS similarity FROM described"))
def sink_json(spark, sf):
    """Search-result records as JSON lines and back; a missing description stays missing."""
    path = run_dir(spark, "json")
    records = T.described_articles(spark, sf).select(
        "article_id", "detail_desc", (F.col("article_id").cast("double") / 8).alias("similarity")
    )
    io.write_json(records, path)
    return io.read_json(spark, path, schemas.SEARCH_RESULT)


@query("season_map_rows", sql("season_map", "SELECT season, product_type_name FROM season_map"))
def season_map_rows(spark, sf):
    """The season map of the catalog's product types as a JSON object, written and read."""
    path = run_dir(spark, "seasons")
    # the file is one object: three seasons, and the distinct product types of the catalog
    grouped = T.season_map(spark, sf).groupBy("season").agg(
        F.sort_array(F.collect_list("product_type_name")).alias("types")
    )
    entries = F.map_from_entries(F.collect_list(F.struct("season", "types")))
    one = grouped.agg(F.to_json(entries).alias("value"))
    one.write.text(path)
    return io.read_season_map(spark, path)


@query(
    "staged_split",
    sql("transactions", f"""SELECT customer_id, count(*) AS n, CAST(max(t_dat) AS VARCHAR) AS last_day
FROM transactions WHERE {between(T.TRAIN)} GROUP BY customer_id"""),
)
def staged_split(spark, sf):
    """A stage that is built once; the second call reads the finished copy."""
    base = run_dir(spark, "stages")
    params = {"train": T.TRAIN, "val": T.VALIDATION}
    inputs = [f"{sf}/lineitem.parquet", f"{sf}/orders.parquet"]
    io.stage(spark, "train", lambda: splits(spark, sf)[0], base, params, inputs=inputs)

    def never():
        raise AssertionError("a finished stage must not be built again")

    train = io.stage(spark, "train", never, base, params, inputs=inputs)
    return train.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.max("t_dat").cast("string").alias("last_day")
    )


def _streamed(spark, sf):
    """The store after four arrivals by day; every customer is touched by several of them."""
    source = run_dir(spark, "arrivals")
    T.activity(spark, sf).repartitionByRange(4, "t_dat").write.parquet(source)
    return refresh_stream(spark, source, None, run_dir(spark, "refreshed"), run_dir(spark, "offsets"), buckets=16)


def _refreshed(rows):
    types = {c: "float" if "spend" in c else "int" for c in schemas.ROLLING_FEATURES}
    cells = [
        (money(c) if "spend" in c else F.col(c)).cast(t).alias(c) for c, t in types.items()
    ]
    return rows.select("txn_id", *cells)


@query("refresh_stream", sql("activity", ROLLED))
def refresh_features(spark, sf):
    """Features after streaming all transactions in equal the batch result."""
    return _refreshed(_streamed(spark, sf).current())


@query(
    "feature_lookup",
    sql("activity", f"""SELECT * FROM ({ROLLED}) WHERE txn_id IN (SELECT txn_id FROM activity WHERE customer_id IN (
  SELECT customer_id FROM activity WHERE t_dat = (SELECT max(t_dat) FROM activity)))"""),
)
def feature_lookup(spark, sf):
    """Features of the customers who were active on the last day, from their buckets of the streamed store."""
    activity = T.activity(spark, sf)
    last = activity.agg(F.max("t_dat")).scalar()
    return _refreshed(_streamed(spark, sf).lookup(activity.where(F.col("t_dat") == last).select("customer_id").distinct()))


@query(
    "packed_embeddings",
    """SELECT CAST(vec_id AS VARCHAR) AS article_id, CAST(len(embedding) AS INTEGER) AS dim, embedding[1] AS first, embedding[64] AS last,
 round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""",
)
def packed_embeddings(spark, sf):
    """Vectors spread over one column a dimension, written, read and packed again."""
    path = run_dir(spark, "wide")
    wide = T.image_embeddings(spark, sf).select(
        "article_id", *[F.col("embedding")[i].alias(f"e_{i}") for i in range(T.EMBEDDING_DIM)]
    )
    io.write_table(wide, path)
    packed = io.pack_embeddings(io.read_table(spark, path), "e_", T.EMBEDDING_DIM)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return packed.select(
        "article_id", F.size("embedding").alias("dim"), F.col("embedding")[0].alias("first"),
        F.col("embedding")[T.EMBEDDING_DIM - 1].alias("last"), F.round(total, 6).alias("total"),
    )
