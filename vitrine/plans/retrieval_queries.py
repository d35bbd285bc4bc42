"""Vectors, retrieval, candidate filtering and the offline job."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import candidates as K
from vitrine.operators import evaluate as V
from vitrine.operators import retrieval as R
from vitrine.operators.clean import split_by_date
from vitrine.operators.encode import label_probs
from vitrine.operators.fold_in import fold_in
from vitrine.operators.pruned import retrieve_threshold_pruned as retrieve_threshold_by_blocks
from vitrine.plans.feature_queries import splits
from vitrine.plans.jobs import run_retrieval
from vitrine.plans.oracle import sql
from vitrine.plans.registry import num, num_sql, query
from vitrine.session import materialize
from vitrine.sources import testdata as T
from vitrine.sources.io import attach_embeddings, embedding_coverage

DIM = T.EMBEDDING_DIM
TOP_K = 12
THRESHOLD = 0.3


def users(spark, sf):
    train, _ = splits(spark, sf)
    return R.content_user_vectors(train, T.image_embeddings(spark, sf), DIM)


def items(spark, sf):
    return R.catalog_vectors(T.articles(spark, sf), T.image_embeddings(spark, sf))


@query(
    "embedding_coverage",
    sql("articles image_embeddings", """SELECT count(embedding) AS mapped_articles, count(*) - count(embedding) AS nonmapped_articles
FROM articles LEFT JOIN image_embeddings USING (article_id)"""),
)
def coverage(spark, sf):
    return embedding_coverage(attach_embeddings(T.articles(spark, sf), T.image_embeddings(spark, sf)))


@query(
    "content_user_vectors",
    sql("user_parts", f"SELECT customer_id, CAST(pos AS INTEGER) AS pos, {num_sql('value')} AS value FROM user_parts"),
)
def content_user_vectors(spark, sf):
    long = users(spark, sf).select("customer_id", F.posexplode("vec").alias("pos", "value"))
    return long.select("customer_id", (F.col("pos") + 1).alias("pos"), num("value").alias("value"))


@query("retrieve_topk", sql("topk", "SELECT customer_id, article_id, score, rank FROM topk"))
def retrieve_topk(spark, sf):
    return R.retrieve_topk(users(spark, sf), items(spark, sf), DIM, TOP_K)


@query(
    "retrieve_topk_blocks",
    sql("topk", "SELECT customer_id, article_id, score, rank FROM topk"),
)
def retrieve_topk_blocks(spark, sf):
    """The same result by the block way that takes over when the items outgrow a broadcast."""
    return R.retrieve_topk(
        users(spark, sf), items(spark, sf), DIM, TOP_K, broadcast_bytes=0, user_block=512, item_block=1024
    )


_THRESHOLD_SQL = f"""SELECT customer_id, article_id, score, CAST(row_number() OVER (PARTITION BY customer_id
  ORDER BY CASE WHEN top < {THRESHOLD} THEN score END DESC, article_id) AS INTEGER) AS rank FROM (
 SELECT *, max(score) OVER (PARTITION BY customer_id) AS top,
  row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS rn FROM scores)
WHERE score >= {THRESHOLD} OR (top < {THRESHOLD} AND rn <= {TOP_K})"""


@query("retrieve_threshold", sql("scores", _THRESHOLD_SQL))
def retrieve_threshold(spark, sf):
    return R.retrieve_threshold(users(spark, sf), items(spark, sf), DIM, THRESHOLD, TOP_K)


@query("retrieve_threshold_pruned", sql("scores", _THRESHOLD_SQL))
def retrieve_threshold_pruned(spark, sf):
    """The same rows from blocks cut by space, of which the pairs too far apart are skipped."""
    return retrieve_threshold_by_blocks(
        users(spark, sf), items(spark, sf), DIM, THRESHOLD, TOP_K, pivots=16, user_block=512, item_block=512
    )


@query(
    "score_pairs",
    sql("scores val", "SELECT txn_id, COALESCE(score, 0.0) AS score FROM val LEFT JOIN scores USING (customer_id, article_id)"),
)
def score_pairs(spark, sf):
    """Scores of the validation purchases."""
    _, val = splits(spark, sf)
    out = R.score_pairs(val.select("txn_id", "customer_id", "article_id"), users(spark, sf), items(spark, sf))
    return out.select("txn_id", "score")


@query("als_retrieval")
def als_retrieval(spark, sf):
    """Top articles from implicit-feedback factors; a seeded fit, so no SQL."""
    train, _ = splits(spark, sf)
    factors, item_factors = R.fit_retrieval(train, rank=8, iterations=4)
    return R.retrieve_topk(factors, item_factors, 8, TOP_K)


@query("als_fold_in")
def als_fold_in(spark, sf):
    """Top articles of every customer of both splits: the fit knows the training purchases only, later customers
    and purchases are folded in; a seeded fit, so no SQL."""
    # read for the fit and, twice, for the purchases that are folded in
    tx = materialize(T.transactions(spark, sf).select("t_dat", "customer_id", "article_id"), "transactions")
    train, val = split_by_date(tx, T.TRAIN, T.VALIDATION)
    _, factors = R.fit_retrieval(train, rank=8, iterations=4)
    factors = materialize(factors, "item-factors")
    vectors = fold_in(train.unionByName(val), factors, 8)
    return R.retrieve_topk(vectors, factors, 8, TOP_K)


@query(
    "recall_at_k",
    sql("topk val", " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS k, {num_sql(f'avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS recall FROM val LEFT JOIN topk USING (customer_id, article_id)"
        for k in (1, 5, 12))),
)
def recall_at_k(spark, sf):
    _, val = splits(spark, sf)
    ranked = R.retrieve_topk(users(spark, sf), items(spark, sf), DIM, TOP_K)
    return V.recall_at_k(val, ranked, [1, 5, 12]).withColumn("recall", num("recall"))


@query(
    "softmax_loss",
    sql("scores val", f"""SELECT count(*) AS n, {num_sql('avg(lse - score)')} AS loss FROM val
JOIN (SELECT customer_id, ln(sum(exp(score))) AS lse FROM scores GROUP BY customer_id) USING (customer_id)
JOIN scores USING (customer_id, article_id)"""),
)
def softmax_loss(spark, sf):
    _, val = splits(spark, sf)
    # read for the truth and for all scores
    u, i = materialize(users(spark, sf), "users"), items(spark, sf)
    truth = R.score_pairs(val.select("txn_id", "customer_id", "article_id"), u, i)
    return V.softmax_loss(truth, u, i, DIM).withColumn("loss", num("loss"))


@query(
    "sampled_softmax_loss",
    sql("val train user_vectors catalog_vectors", f"""SELECT count(*) AS n, {num_sql('avg(lse - own)')} AS loss FROM (
 SELECT a.txn_id, ln(sum(exp(s - ln(b.q)))) AS lse, max(s - ln(b.q)) FILTER (a.txn_id = b.txn_id) AS own
 FROM (SELECT a.*, b.txn_id AS b_id, b.q AS b_q, COALESCE(round(list_dot_product(a.u, b.i), 9), 0.0) AS s FROM batch a JOIN batch b USING (batch_id)) a
 JOIN batch b ON b.txn_id = a.b_id GROUP BY a.txn_id)""",
        """unit_u AS MATERIALIZED (SELECT customer_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u FROM user_vectors),
unit_i AS MATERIALIZED (SELECT article_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS i FROM catalog_vectors),
batch AS MATERIALIZED (SELECT txn_id, u, i, q, (row_number() OVER (ORDER BY md5(txn_id)) - 1) // 256 AS batch_id
 FROM val LEFT JOIN unit_u USING (customer_id) LEFT JOIN unit_i USING (article_id)
 JOIN (SELECT article_id, count(*) / (SELECT count(*) FROM train) AS q FROM train GROUP BY article_id) USING (article_id))"""),
)
def sampled_softmax_loss(spark, sf):
    train, val = splits(spark, sf)
    out = V.sampled_softmax_loss(val, users(spark, sf), items(spark, sf), label_probs(train), DIM, 256)
    return out.withColumn("loss", num("loss"))


# ---- candidate lists and rules ---------------------------------------------------------


def _lists(spark, sf):
    return K.collapse_candidates(T.candidates(spark, sf))


_COLLAPSED = "SELECT customer_id, string_agg(article_id, ' ' ORDER BY rank) AS predicted_article_ids FROM {} GROUP BY customer_id"


@query("candidates_collapsed", sql("candidates", _COLLAPSED.format("candidates")))
def candidates_collapsed(spark, sf):
    return _lists(spark, sf)


@query("candidates_exploded", sql("candidates", "SELECT * FROM candidates"))
def candidates_exploded(spark, sf):
    padded = _lists(spark, sf).withColumn(
        K.LIST_COL, F.concat(F.lit("  "), F.regexp_replace(K.LIST_COL, " ", "  "), F.lit(" "))
    )
    return K.explode_candidates(padded)


@query("feed_customers", sql("candidates", "SELECT DISTINCT customer_id FROM candidates"))
def feed_customers(spark, sf):
    return K.feed_customers(T.candidates(spark, sf))


BAND = "article_price >= min_price * (1 - {r}::DOUBLE) AND article_price <= max_price * (1 + {r}::DOUBLE)"


@query(
    "candidates_price_band",
    sql("candidates article_prices price_range", f"""SELECT customer_id, article_id, rank, {num_sql('article_price')} AS article_price, min_price, max_price
FROM candidates JOIN article_prices USING (article_id) JOIN price_range USING (customer_id) WHERE {BAND.format(r=0.2)}"""),
)
def candidates_price_band(spark, sf):
    out = K.price_band(T.candidates(spark, sf), T.transactions(spark, sf), 0.2)
    return out.select("customer_id", "article_id", "rank", num("article_price").alias("article_price"), "min_price", "max_price")


def _flags(spark, sf):
    """Stock and place flags that depend on the article number; some articles have none."""
    key = F.col("article_id").cast("bigint")
    return T.articles(spark, sf).where(key % 13 != 0).select(
        "article_id",
        (key % 7 != 0).cast("int").alias("is_in_stock"),
        F.lit(1).alias("is_seasonal"),
        (key % 11 != 0).cast("int").alias("location_available"),
    )


AVAILABLE = "CAST(article_id AS BIGINT) % 13 <> 0 AND CAST(article_id AS BIGINT) % 7 <> 0 AND CAST(article_id AS BIGINT) % 11 <> 0"


@query("candidates_available", sql("candidates", f"SELECT * FROM candidates WHERE {AVAILABLE}"))
def candidates_available(spark, sf):
    return K.available(T.candidates(spark, sf), _flags(spark, sf))


def _filtered_sql(source, r, season=""):
    return f"""SELECT customer_id, article_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY rank) AS INTEGER) AS rank
FROM {source} JOIN article_prices USING (article_id) JOIN price_range USING (customer_id)
{season} WHERE {BAND.format(r=r)}"""


@query(
    "candidates_filtered",
    sql("candidates article_prices price_range articles season_map", _filtered_sql(
        "candidates", 0.2, "JOIN articles USING (article_id) LEFT JOIN season_map USING (product_type_name)"
    ) + f" AND {AVAILABLE} AND season IN ('summer_spring', 'all_seasons')"),
)
def candidates_filtered(spark, sf):
    return K.filter_candidates(
        T.candidates(spark, sf), T.articles(spark, sf), T.transactions(spark, sf), 0.2,
        flags=_flags(spark, sf), season_map=T.season_map(spark, sf), as_of=F.lit("2001-06-15").cast("date"),
    )


_ALL_SCORES = """COALESCE(round(list_dot_product(u.vec, i.vec)
    / sqrt(list_dot_product(u.vec, u.vec) * list_dot_product(i.vec, i.vec)), 9), 0.0)"""


@query(
    "offline_candidates",
    sql("train val user_vectors catalog_vectors", _COLLAPSED.format("kept"),
        f"""both_parts AS MATERIALIZED (SELECT * FROM train UNION ALL SELECT * FROM val),
found AS MATERIALIZED (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS rank
 FROM (SELECT w.customer_id, i.article_id, {_ALL_SCORES} AS score FROM (SELECT DISTINCT customer_id FROM both_parts) w
  LEFT JOIN user_vectors u ON u.customer_id = w.customer_id CROSS JOIN catalog_vectors i) QUALIFY rank <= {TOP_K}),
kept AS (SELECT customer_id, article_id, rank FROM found
 JOIN (SELECT article_id, avg(price) AS article_price FROM both_parts GROUP BY article_id) USING (article_id)
 JOIN (SELECT customer_id, min(price) AS min_price, max(price) AS max_price FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
   ORDER BY t_dat DESC, txn_id DESC) AS rn FROM both_parts) WHERE rn <= 10 GROUP BY customer_id) USING (customer_id)
 WHERE {BAND.format(r=0.6)})"""),
)
def offline_candidates(spark, sf):
    tx = materialize(T.transactions(spark, sf), "transactions")
    train, val = split_by_date(tx, T.TRAIN, T.VALIDATION)
    return run_retrieval(train, val, T.articles(spark, sf), T.image_embeddings(spark, sf), DIM)
