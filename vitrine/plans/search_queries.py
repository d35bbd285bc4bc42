"""Feeds, facets, text search and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import candidates as K
from vitrine.operators import search as S
from vitrine.operators import text_join as J
from vitrine.operators.analytics import facet_rows
from vitrine.operators.clean import display_defaults
from vitrine.plans.jobs import run_search
from vitrine.plans.oracle import STOP_LIST, sql
from vitrine.plans.registry import num, num_sql, query, with_nums
from vitrine.session import materialize
from vitrine.sources import testdata as T
from vitrine.sources.schemas import FACETS

DIM = T.EMBEDDING_DIM
REQUEST = {"product_type": "ring", "colour_group": "red", "department": "", "price": "9"}


def _docs(spark, sf):
    return T.described_articles(spark, sf).select("article_id", "detail_desc")


# ---- feed ------------------------------------------------------------------------------

_VIEW = """SELECT customer_id, article_id, rank, COALESCE(prod_name, 'N/A') AS prod_name, COALESCE(detail_desc, '') AS detail_desc,
 '/images/' || substr(lpad(article_id, 10, '0'), 1, 3) || '/' || lpad(article_id, 10, '0') || '.jpg' AS image_path"""
_VIEW_COLS = ["customer_id", "article_id", "rank", "prod_name", "detail_desc", "image_path"]


@query(
    "feed_details",
    sql("candidates articles", """SELECT customer_id, article_id, rank, prod_name, product_type_name, section_name FROM candidates
LEFT JOIN (SELECT * FROM articles WHERE garment_group_name <> 'Garment_0') USING (article_id)"""),
)
def feed_details(spark, sf):
    """Feed order with details; ids missing from the article table stay."""
    known = T.articles(spark, sf).where(F.col("garment_group_name") != "Garment_0")
    out = K.feed_lookup(T.candidates(spark, sf), known)
    return out.select("customer_id", "article_id", "rank", "prod_name", "product_type_name", "section_name")


@query(
    "feed_faceted",
    sql("candidates described", f"{_VIEW} FROM candidates LEFT JOIN described USING (article_id) WHERE product_type_name = 'ring' AND colour_group_name = 'red'"),
)
def feed_faceted(spark, sf):
    shown, _ = K.feed_view(T.candidates(spark, sf), T.described_articles(spark, sf), REQUEST)
    return shown.select(*_VIEW_COLS)


@query("feed_page", sql("candidates described", f"{_VIEW} FROM candidates LEFT JOIN described USING (article_id) WHERE rank > 18 AND rank <= 36"))
def feed_page(spark, sf):
    """Page 2 of every feed. The page is cut before the details are looked up."""
    feed = K.page(K.cap(T.candidates(spark, sf), K.FEED_CAP), 2)
    return display_defaults(K.feed_lookup(feed, T.described_articles(spark, sf))).select(*_VIEW_COLS)


@query("feed_page_counts", sql("candidates", "SELECT customer_id, CAST(ceil(count(*) / 18) AS BIGINT) AS pages FROM candidates GROUP BY customer_id"))
def feed_page_counts(spark, sf):
    return K.page_counts(T.candidates(spark, sf))


@query(
    "feed_facet_options",
    sql("candidates articles", " UNION ".join(
        f"SELECT customer_id, '{k}' AS facet, {c} AS value FROM candidates JOIN articles USING (article_id) WHERE {c} IS NOT NULL"
        for k, c in FACETS.items())),
)
def feed_facet_options(spark, sf):
    return K.feed_facet_options(T.candidates(spark, sf), T.articles(spark, sf))


# ---- text ------------------------------------------------------------------------------


@query("token_counts", sql("words", "SELECT term, count(*) AS n, count(DISTINCT article_id) AS docs FROM words GROUP BY term"))
def token_counts(spark, sf):
    per_doc = S.term_counts(_docs(spark, sf), "detail_desc")
    return per_doc.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query(
    "bigram_counts",
    sql("described", f"""SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term
FROM (SELECT list_filter(regexp_extract_all(lower(COALESCE(detail_desc, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({STOP_LIST})) AS w
 FROM described)) GROUP BY term"""),
)
def bigram_counts(spark, sf):
    return S.tokens(_docs(spark, sf), ngram=(2, 2)).groupBy("term").agg(F.count("*").alias("n"))


def _model(spark, sf):
    return S.fit_tfidf(_docs(spark, sf))


@query("tfidf_vocabulary", sql("vocab", "SELECT term, corpus_count, df FROM vocab"))
def tfidf_vocabulary(spark, sf):
    return _model(spark, sf).vocabulary.select("term", "corpus_count", "df")


@query("tfidf_idf", sql("vocab", f"SELECT term, {num_sql('idf')} AS idf FROM vocab"))
def tfidf_idf(spark, sf):
    return _model(spark, sf).vocabulary.select("term", num("idf").alias("idf"))


@query("tfidf_weights", sql("weights", f"SELECT article_id, term, {num_sql('weight')} AS weight FROM weights"))
def tfidf_weights(spark, sf):
    return with_nums(_model(spark, sf).weights, ["weight"])


def _stored_model(spark, sf):
    """The fitted model as written tables, as a search would find it."""
    docs = _docs(spark, sf)
    m = S.fit_tfidf(docs, counts=materialize(S.term_counts(docs, "detail_desc"), "term_counts"))
    vocabulary = materialize(m.vocabulary, "vocabulary")
    return S.TfIdf(vocabulary, materialize(m.weights, "weights"), m.ngram, m.stopwords)


_QUERY_TERMS = "SELECT term FROM vocab ORDER BY corpus_count DESC, term LIMIT 3"
_TEXT = f"""SELECT customer_id, article_id, rank, similarity FROM candidates JOIN (
 SELECT article_id, round(sum(weight * idf) / (SELECT sqrt(sum(idf * idf)) FROM vocab WHERE term IN ({_QUERY_TERMS})), 9) AS similarity
 FROM weights JOIN vocab USING (term) WHERE term IN ({_QUERY_TERMS}) GROUP BY article_id) USING (article_id) WHERE similarity >= 0.2"""


def _query_text(model: S.TfIdf) -> str:
    """The three most frequent terms and two unknown words, as a shopper's query."""
    rows = model.vocabulary.orderBy(F.desc("corpus_count"), "term").limit(3).select("term").collect()
    return "The " + " ".join(r.term.upper() for r in rows) + " qqzzxx of zzqqxx"


def _text_results(spark, sf):
    model = _stored_model(spark, sf)
    return S.text_search(_query_text(model), T.candidates(spark, sf), model)


@query("text_search", sql("candidates weights", _TEXT))
def text_search(spark, sf):
    return _text_results(spark, sf)


@query(
    "text_search_batch",
    sql("weights", """SELECT q.article_id AS query_id, d.article_id, round(sum(q.weight * d.weight), 9) AS similarity
FROM weights q JOIN weights d USING (term) GROUP BY q.article_id, d.article_id HAVING round(sum(q.weight * d.weight), 9) >= 0.5"""),
)
def text_search_batch(spark, sf):
    """Every description asked of all descriptions."""
    queries = _docs(spark, sf).select(F.col("article_id").alias("query_id"), F.col("detail_desc").alias("text"))
    return J.text_search_batch(queries, _stored_model(spark, sf), 0.5)


@query("search_details", sql("candidates weights", f"SELECT customer_id, article_id, rank, detail_desc, similarity FROM ({_TEXT}) JOIN described USING (article_id)"))
def search_details(spark, sf):
    model = _stored_model(spark, sf)
    found = run_search("text", _query_text(model), T.candidates(spark, sf), T.described_articles(spark, sf), model)
    return found.select("customer_id", "article_id", "rank", "detail_desc", "similarity")


@query(
    "search_faceted",
    sql("candidates weights", f"{_VIEW} FROM ({_TEXT}) JOIN described USING (article_id) WHERE product_group_name = (SELECT min(product_group_name) FROM articles)"),
)
def search_faceted(spark, sf):
    """Facets on saved results: the search runs once, the filter reads its table."""
    saved = materialize(K.result_details(_text_results(spark, sf), T.described_articles(spark, sf)), "results")
    lowest = facet_rows(T.articles(spark, sf), {"product_group": FACETS["product_group"]}).agg(F.min("value")).scalar()
    kept = K.cap(saved, K.RESULT_CAP).where(F.col("product_group_name") == lowest)
    return display_defaults(kept).select(*_VIEW_COLS)


# ---- vectors ---------------------------------------------------------------------------

_COS = "round(list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})), 9)"
_QV = "(SELECT embedding FROM image_embeddings ORDER BY article_id LIMIT 1)"


def _first_vector(spark, sf):
    emb = T.image_embeddings(spark, sf)
    return emb.agg(F.min_by("embedding", "article_id")).scalar()


@query(
    "vector_search",
    sql("candidates image_embeddings", f"""SELECT customer_id, article_id, similarity,
 CAST(row_number() OVER (PARTITION BY customer_id ORDER BY similarity DESC, article_id) AS INTEGER) AS rank
FROM candidates JOIN (SELECT article_id, {_COS.format(a='embedding', b='q')} AS similarity FROM image_embeddings CROSS JOIN (SELECT {_QV} AS q))
USING (article_id) WHERE similarity >= 0.2"""),
)
def vector_search(spark, sf):
    out = S.vector_search(_first_vector(spark, sf), T.candidates(spark, sf), T.image_embeddings(spark, sf), 0.2)
    return out.select("customer_id", "article_id", "similarity", "rank")


def _label_queries(spark, sf):
    """One query vector per label: the mean of its vectors."""
    raw = T.table(spark, sf, "embeddings")
    means = raw.groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(DIM)])
    return means.select(
        F.col("label").cast("string").alias("query_id"), F.array(*[f"m{i}" for i in range(DIM)]).alias("vec")
    )


@query(
    "vector_search_batch",
    sql("image_embeddings", f"""SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, article_id) AS INTEGER) AS rank FROM (
SELECT query_id, article_id, {_COS.format(a='vec', b='embedding')} AS similarity FROM (
 SELECT query_id, list(m ORDER BY pos) AS vec FROM (SELECT CAST(label AS VARCHAR) AS query_id, pos, avg(v) AS m
  FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY query_id)
 CROSS JOIN image_embeddings) WHERE similarity >= 0.3"""),
)
def vector_search_batch(spark, sf):
    return S.vector_search_batch(_label_queries(spark, sf), T.image_embeddings(spark, sf), DIM, 0.3)


@query(
    "knn_catalog",
    sql("image_embeddings", f"""SELECT query_id, article_id, similarity, CAST(rank AS INTEGER) AS rank FROM (
SELECT q.article_id AS query_id, i.article_id, {_COS.format(a='q.embedding', b='i.embedding')} AS similarity,
 row_number() OVER (PARTITION BY q.article_id ORDER BY similarity DESC, i.article_id) AS rank
FROM image_embeddings q CROSS JOIN image_embeddings i) WHERE rank <= 6"""),
)
def knn_catalog(spark, sf):
    """Every catalog vector's nearest items, itself among them."""
    emb = T.image_embeddings(spark, sf)
    return S.knn(emb.select(F.col("article_id").alias("query_id"), F.col("embedding").alias("vec")), emb, DIM, 6)


@query("knn_lsh")
def knn_lsh(spark, sf):
    """Every catalog vector's nearest items by random projections; drawn projections, so no SQL."""
    emb = T.image_embeddings(spark, sf)
    return S.knn_lsh(emb.select(F.col("article_id").alias("query_id"), F.col("embedding").alias("vec")), emb, DIM, 6, 0.1)
