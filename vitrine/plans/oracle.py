"""SQL building blocks of the checks: the retail views and the hash draw.

These restate ``vitrine.sources.testdata`` and the operators' rules independently, in SQL
that runs on the given tables.
"""

from __future__ import annotations

from vitrine.functions.text import ENGLISH_STOPWORDS
from vitrine.sources.testdata import SEASON_OF_TYPE, TRAIN, VALIDATION


def unit(*cols: str, salt: str = "") -> str:
    joined = ", ".join([*cols, f"'{salt}'"])
    return f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def between(rng: tuple[str, str], col: str = "t_dat") -> str:
    return f"{col} BETWEEN DATE '{rng[0]}' AND DATE '{rng[1]}'"


STOP_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOPWORDS)

VIEWS: dict[str, tuple[list[str], str]] = {
    "transactions": (
        [],
        """SELECT CAST(o_orderdate AS DATE) AS t_dat, CAST(o_custkey AS VARCHAR) AS customer_id,
  CAST(l_partkey AS VARCHAR) AS article_id, l_extendedprice AS price,
  CAST(1 + o_orderkey % 2 AS INTEGER) AS sales_channel_id,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
            CAST(round(l_extendedprice * 100) AS BIGINT)) AS txn_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "activity": (
        [],
        """SELECT CAST(ts AS DATE) AS t_dat, CAST(user_id AS VARCHAR) AS customer_id,
  event_type AS article_id, value AS price, CAST(event_id AS VARCHAR) AS txn_id FROM events""",
    ),
    "articles": (
        [],
        """SELECT CAST(p_partkey AS VARCHAR) AS article_id, p_name AS prod_name,
  string_split(p_name, ' ')[2] AS product_type_name, p_type AS product_group_name,
  string_split(p_name, ' ')[1] AS colour_group_name, p_brand AS department_name,
  'Index_' || (p_size % 5) AS index_name, 'Section_' || (p_size % 10) AS section_name,
  'Garment_' || (p_partkey % 7) AS garment_group_name,
  'Pattern_' || (p_partkey % 4) AS graphical_appearance_name
FROM part""",
    ),
    "described": (
        ["articles"],
        """SELECT a.*, d.text AS detail_desc FROM articles a
LEFT JOIN documents d ON a.article_id = CAST(d.doc_id AS VARCHAR)""",
    ),
    "raw_customers": (
        [],
        """SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
  CASE WHEN c_custkey % 3 = 0 THEN '1.0' END AS FN,
  CASE WHEN c_custkey % 3 = 0 THEN '1.0' END AS Active,
  CASE WHEN c_custkey % 97 = 3 THEN NULL WHEN c_custkey % 100 = 2 THEN 'LEFT CLUB'
       WHEN c_custkey % 15 = 1 THEN 'PRE-CREATE' ELSE 'ACTIVE' END AS club_member_status,
  CASE WHEN c_custkey % 89 = 5 THEN NULL WHEN c_custkey % 101 = 4 THEN 'None'
       WHEN c_custkey % 5 < 2 THEN 'Regularly' ELSE 'NONE' END AS fashion_news_frequency,
  CASE WHEN c_custkey % 50 <> 7 THEN CAST(16 + c_custkey % 80 AS DOUBLE) END AS age,
  'P' || c_nationkey AS postal_code
FROM customer""",
    ),
    "customers": (
        ["raw_customers"],
        """SELECT customer_id, COALESCE(FN, 'UNKNOWN') AS FN, COALESCE(Active, 'UNKNOWN') AS Active,
  COALESCE(club_member_status, 'UNKNOWN') AS club_member_status,
  CASE WHEN fashion_news_frequency IS NULL THEN 'UNKNOWN'
       WHEN fashion_news_frequency = 'None' THEN 'NONE' ELSE fashion_news_frequency END
    AS fashion_news_frequency,
  age, CASE WHEN age <= 25 THEN '[16, 25]' WHEN age <= 35 THEN '[26, 35]'
            WHEN age <= 45 THEN '[36, 45]' WHEN age <= 55 THEN '[46, 55]'
            WHEN age <= 65 THEN '[56, 65]' ELSE '[66, 99]' END AS age_interval, postal_code
FROM (SELECT * REPLACE (COALESCE(age, (SELECT median(age) FROM raw_customers)) AS age)
      FROM raw_customers)""",
    ),
    "image_embeddings": (
        [],
        "SELECT CAST(vec_id AS VARCHAR) AS article_id, embedding::DOUBLE[] AS embedding FROM embeddings",
    ),
    "season_map": (
        ["articles"],
        "SELECT DISTINCT product_type_name, CASE product_type_name "
        + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in SEASON_OF_TYPE.items())
        + " END AS season FROM articles WHERE product_type_name IN ("
        + ", ".join(f"'{t}'" for t in SEASON_OF_TYPE)
        + ")",
    ),
    "candidates": (
        ["transactions"],
        """SELECT customer_id, article_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id
    ORDER BY md5(concat_ws('|', customer_id, article_id, 'cand'))) AS rank
  FROM (SELECT DISTINCT customer_id, article_id FROM transactions)) WHERE rank <= 50""",
    ),
    "enriched": (
        ["transactions", "customers", "articles"],
        """SELECT t.*, c.* EXCLUDE (customer_id), a.* EXCLUDE (article_id)
FROM transactions t JOIN customers c USING (customer_id) JOIN articles a USING (article_id)""",
    ),
    "train": (["transactions"], f"SELECT * FROM transactions WHERE {between(TRAIN)}"),
    "val": (["transactions"], f"SELECT * FROM transactions WHERE {between(VALIDATION)}"),
    "train_customers": (
        ["train"],
        "SELECT customer_id FROM train GROUP BY customer_id HAVING count(*) > 40",
    ),
    "popularity": (
        ["train_customers"],
        """SELECT article_id, count(*) AS n FROM train
WHERE customer_id IN (SELECT customer_id FROM train_customers) GROUP BY article_id""",
    ),
    "warm_articles": (["popularity"], "SELECT article_id FROM popularity WHERE n > 12"),
    "warm_train": (
        ["warm_articles", "enriched"],
        f"""SELECT * FROM enriched WHERE {between(TRAIN)}
AND customer_id IN (SELECT customer_id FROM train_customers)
AND article_id IN (SELECT article_id FROM warm_articles)""",
    ),
    "warm_val": (
        ["warm_articles", "enriched"],
        f"""SELECT * FROM enriched WHERE {between(VALIDATION)}
AND customer_id IN (SELECT customer_id FROM train_customers)
AND article_id IN (SELECT article_id FROM warm_articles)""",
    ),
    "catalog_vectors": (
        ["articles", "image_embeddings"],
        """SELECT a.article_id, e.embedding AS vec
FROM articles a LEFT JOIN image_embeddings e USING (article_id)""",
    ),
    "user_parts": (
        ["train", "image_embeddings"],
        """SELECT customer_id, pos, sum(v) / count(*) AS value FROM (
  SELECT customer_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
  FROM train JOIN image_embeddings USING (article_id)) GROUP BY customer_id, pos""",
    ),
    "user_vectors": (
        ["user_parts"],
        "SELECT customer_id, list(value ORDER BY pos) AS vec FROM user_parts GROUP BY customer_id",
    ),
    "scores": (
        ["user_vectors", "catalog_vectors"],
        """SELECT customer_id, article_id, COALESCE(round(list_dot_product(u.vec, i.vec)
    / sqrt(list_dot_product(u.vec, u.vec) * list_dot_product(i.vec, i.vec)), 9), 0.0) AS score
FROM user_vectors u CROSS JOIN catalog_vectors i""",
    ),
    "topk": (
        ["scores"],
        """SELECT customer_id, article_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS rank
  FROM scores) WHERE rank <= 12""",
    ),
    "article_prices": (
        ["transactions"],
        "SELECT article_id, avg(price) AS article_price FROM transactions GROUP BY article_id",
    ),
    "price_range": (
        ["transactions"],
        """SELECT customer_id, min(price) AS min_price, max(price) AS max_price FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, txn_id DESC) AS rn
  FROM transactions) WHERE rn <= 10 GROUP BY customer_id""",
    ),
    "judged": (
        ["transactions"],
        f"""SELECT txn_id, {unit('txn_id', salt='score')} AS score,
  CAST({unit('txn_id', salt='label')} < 0.3 AS INTEGER) AS label FROM transactions""",
    ),
    "words": (
        ["described"],
        f"""SELECT article_id, term FROM (SELECT article_id,
    unnest(regexp_extract_all(lower(COALESCE(detail_desc, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM described) WHERE term NOT IN ({STOP_LIST})""",
    ),
    "counts": (["words"], "SELECT article_id, term, count(*) AS tf FROM words GROUP BY ALL"),
    "vocab": (
        ["counts"],
        """SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_count, count(*) AS df,
  ln((1 + (SELECT count(*) FROM described)) / (1 + count(*))::DOUBLE) + 1 AS idf
FROM counts GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000""",
    ),
    "weights": (
        ["vocab"],
        """SELECT article_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf)
  OVER (PARTITION BY article_id)) AS weight FROM counts JOIN vocab USING (term)""",
    ),
}


def _needed(name: str, seen: list[str]) -> None:
    for dep in VIEWS[name][0]:
        _needed(dep, seen)
    if name not in seen:
        seen.append(name)


def sql(views: str, body: str, extra: str = "") -> str:
    """``body`` after a WITH list of the named views, what they need, and ``extra``."""
    seen: list[str] = []
    for name in views.split():
        _needed(name, seen)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in seen]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body
