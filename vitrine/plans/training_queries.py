"""Dictionaries, encoding, normalisation and negative sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import analytics as A
from vitrine.operators import encode as N
from vitrine.operators import features as E
from vitrine.operators import negatives as G
from vitrine.plans.feature_queries import (
    ART_FEATS_SQL,
    CUST_FEATS_SQL,
    CUSTOMER_MIN,
    customers,
    splits,
    warm,
    warm_parts,
    with_attributes,
)
from vitrine.plans.oracle import between, sql, unit
from vitrine.plans.registry import num, num_sql, query, with_nums
from vitrine.operators.clean import split_by_date
from vitrine.sources import testdata as T
from vitrine.sources.schemas import ARTICLE_CATEG, CUSTOMER_CATEG, LABEL

_FEATURES = [c for c in ARTICLE_CATEG + CUSTOMER_CATEG if c != "article_id"]
_TOKENS = " UNION ".join(
    [f"SELECT '{c}' AS feature, {c} AS token FROM etrain WHERE {c} IS NOT NULL" for c in _FEATURES]
    + ["SELECT 'article_id' AS feature, article_id AS token FROM articles"]
)
DICT_CTE = f"""etrain AS MATERIALIZED (SELECT * FROM enriched WHERE {between(T.TRAIN)}),
dicts AS MATERIALIZED (SELECT feature, token, CAST(row_number() OVER (PARTITION BY feature ORDER BY md5(token))
 - CASE WHEN feature = 'article_id' THEN 1 ELSE 0 END AS INTEGER) AS idx FROM ({_TOKENS}))"""


def _dicts(spark, sf):
    return N.build_dictionaries(splits(spark, sf)[0], customers(spark, sf), T.articles(spark, sf))


@query("dictionaries", sql("enriched", "SELECT feature, token, idx FROM dicts", DICT_CTE))
def dictionaries(spark, sf):
    return _dicts(spark, sf)


@query(
    "feature_cardinality",
    sql("enriched", """SELECT feature, count(*) + 1 AS vocab_size, CAST(trunc(3 * log2(count(*) + 1)) AS INTEGER) AS retrieval_width,
 CAST(trunc(log2(count(*) + 1)) AS INTEGER) AS ranking_width FROM dicts GROUP BY feature""", DICT_CTE),
)
def feature_cardinality(spark, sf):
    return N.feature_cardinality(_dicts(spark, sf))


_IDX = [(c, "etrain") for c in CUSTOMER_CATEG + ARTICLE_CATEG]
_LOOKUPS = " ".join(
    f"LEFT JOIN dicts d{i} ON d{i}.feature = '{c}' AND d{i}.token = v.{c}" for i, (c, _) in enumerate(_IDX)
)


@query(
    "encoded_train",
    sql("enriched", f"""SELECT txn_id, {', '.join(f'COALESCE(d{i}.idx, 0) AS {c}_idx' for i, (c, _) in enumerate(_IDX))},
 CAST(price AS FLOAT) AS price FROM etrain v {_LOOKUPS}""", DICT_CTE),
)
def encoded_train(spark, sf):
    train, _ = splits(spark, sf)
    cust, art = customers(spark, sf), T.articles(spark, sf)
    out = N.encode(train, cust, art, N.build_dictionaries(train, cust, art))
    return out.select("txn_id", *[f"{c}_idx" for c, _ in _IDX], F.col("price").cast("float").alias("price"))


@query(
    "encoded_validation",
    sql("enriched", f"""SELECT txn_id, {', '.join(f'COALESCE(d{i}.idx, 0) AS {c}_idx' for i, (c, _) in enumerate(_IDX))}
FROM (SELECT * FROM enriched WHERE {between(T.VALIDATION)}) v {_LOOKUPS.replace('dicts', 'late_dicts')}""",
        DICT_CTE.replace("etrain", "ltrain").replace("dicts", "late_dicts").replace(
            between(T.TRAIN), "t_dat BETWEEN DATE '2000-12-15' AND DATE '2000-12-31'")),
)
def encoded_validation(spark, sf):
    """Validation rows with dictionaries of the last training fortnight: unknown tokens are 0."""
    cust, art = customers(spark, sf), T.articles(spark, sf)
    late, val = split_by_date(T.transactions(spark, sf), ("2000-12-15", "2000-12-31"), T.VALIDATION)
    out = N.encode(val, cust, art, N.build_dictionaries(late, cust, art))
    return out.select("txn_id", *[f"{c}_idx" for c, _ in _IDX])


@query("decoded_ids", sql("articles train", "SELECT txn_id, article_id AS token FROM train"))
def decoded_ids(spark, sf):
    dicts = _dicts(spark, sf)
    train, _ = splits(spark, sf)
    idx = dicts.where(F.col("feature") == "article_id").select(F.col("token").alias("article_id"), "idx")
    coded = train.select("txn_id", "article_id").join(idx, "article_id").select("txn_id", "idx")
    return N.decode(coded, dicts, "article_id", "idx").select("txn_id", "token")


_NORMED = ["price", "age"]


@query(
    "normalized_features",
    sql("warm_train warm_val", "SELECT txn_id, " + ", ".join(
        num_sql(f"({c} - (SELECT avg({c}) FROM warm_train)) / greatest(sqrt((SELECT var_pop({c}) FROM warm_train)), 1e-7)") + f" AS {c}_z"
        for c in _NORMED) + " FROM warm_val"),
)
def normalized_features(spark, sf):
    train, test, _ = warm(spark, sf)
    train, test = with_attributes(spark, sf, train), with_attributes(spark, sf, test)
    out = N.normalize(test, N.fit_normalizer(train, _NORMED), _NORMED)
    return with_nums(out.select("txn_id", *[f"{c}_z" for c in _NORMED]), [f"{c}_z" for c in _NORMED])


@query("label_probs", sql("train", f"SELECT article_id, {num_sql('count(*) / (SELECT count(*) FROM train) * 1e3')} AS q_e3 FROM train GROUP BY article_id"))
def label_probs(spark, sf):
    train, _ = splits(spark, sf)
    return N.label_probs(train).select("article_id", num(F.col("q") * 1e3).alias("q_e3"))


# ---- negatives -----------------------------------------------------------------------

_STEPS = "[" + ", ".join(str(s) for s in G.WALK_STEPS) + "]"


@query(
    "uniform_negatives",
    sql("train articles", f"""SELECT customer_id, article_id, 0.0::DOUBLE AS bought FROM (
 SELECT m.*, row_number() OVER (PARTITION BY customer_id ORDER BY j) AS rn FROM (
  SELECT customer_id, j, c.article_id FROM (
   SELECT customer_id, CAST(floor({unit('customer_id', salt='42')} * size) AS BIGINT) AS first,
    {_STEPS}[CAST(floor({unit('customer_id', salt='42step')} * {len(G.WALK_STEPS)}) AS INTEGER) + 1]::BIGINT AS step,
    unnest(range(least(n + 10, size))) AS j, size
   FROM (SELECT customer_id, count(DISTINCT article_id) AS n FROM train GROUP BY customer_id)
   CROSS JOIN (SELECT count(*) AS size FROM articles)) w
  JOIN (SELECT article_id, row_number() OVER (ORDER BY md5(article_id)) - 1 AS slot FROM articles) c
   ON c.slot = (w.first + w.j * w.step) % w.size) m
 ANTI JOIN train t ON t.customer_id = m.customer_id AND t.article_id = m.article_id) WHERE rn <= 10"""),
)
def uniform_negatives(spark, sf):
    train, _ = splits(spark, sf)
    return G.uniform_negatives(train, T.articles(spark, sf), 10)


_DRAWN = f"""line AS MATERIALIZED (SELECT article_id, n, sum(n) OVER (ORDER BY md5(article_id)) - n AS start FROM popularity),
draws AS MATERIALIZED (SELECT txn_id, customer_id, j, CAST(floor({unit('txn_id', 'j', salt='42')} * (SELECT sum(n) FROM popularity)) AS BIGINT) AS point
 FROM {{source}} CROSS JOIN (SELECT unnest(range({{n}})) AS j)),
negs AS MATERIALIZED (SELECT d.txn_id, d.customer_id, d.j, l.article_id FROM draws d ASOF JOIN line l ON d.point >= l.start)"""


@query(
    "popularity_negatives",
    sql("train popularity", "SELECT txn_id, customer_id, CAST(j AS INTEGER) AS j, article_id, 0.0::DOUBLE AS bought FROM negs",
        _DRAWN.format(source="train", n=2)),
)
def popularity_negatives(spark, sf):
    train, _ = splits(spark, sf)
    kept = E.keep_keys(train, E.warm_keys(train, "customer_id", CUSTOMER_MIN), "customer_id")
    # narrow slices, so that popular articles span several of them even on small tables
    return G.popularity_negatives(train, E.article_popularity(kept), n=2, slice_width=5_000)


_SET_COLS = ["age", "club_member_status", "cust_nb_transactions", "product_type_name", "department_name", "art_nb_transactions", "art_age_mean"]


@query(
    "training_set",
    sql("warm_train popularity articles", f"""SELECT txn_id, customer_id, article_id, CAST(j AS INTEGER) AS j, bought, age, club_member_status,
 cust_nb_transactions, product_type_name, department_name, art_nb_transactions, {num_sql('art_age_mean')} AS art_age_mean FROM (
 SELECT w.txn_id, w.customer_id, w.article_id, -1 AS j, 1.0::DOUBLE AS bought, age, club_member_status, cust_nb_transactions,
  product_type_name, department_name, art_nb_transactions, art_age_mean
 FROM warm_train w JOIN cf USING (customer_id) JOIN af USING (article_id)
 UNION ALL
 SELECT n.txn_id, n.customer_id, n.article_id, n.j, 0.0::DOUBLE AS bought, w.age, w.club_member_status, cust_nb_transactions,
  a.product_type_name, a.department_name, COALESCE(art_nb_transactions, 0), COALESCE(art_age_mean, 0)
 FROM negs n JOIN warm_train w USING (txn_id) JOIN cf ON cf.customer_id = n.customer_id
 JOIN articles a ON a.article_id = n.article_id LEFT JOIN af ON af.article_id = n.article_id)""",
        _DRAWN.format(source="warm_train", n=1) + f", cf AS ({CUST_FEATS_SQL}), af AS ({ART_FEATS_SQL})"),
)
def training_set(spark, sf):
    bare, _, popularity = warm_parts(spark, sf)
    train = with_attributes(spark, sf, bare)
    known = customers(spark, sf).join(E.customer_features(train), "customer_id", "left")
    out = G.training_set(
        bare, popularity, T.articles(spark, sf), E.article_features(train),
        ["age", "club_member_status", "cust_nb_transactions"], customers=known,
    )
    return with_nums(out.select("txn_id", "customer_id", "article_id", "j", LABEL, *_SET_COLS), ["art_age_mean"])


@query(
    "table_profile",
    sql("enriched", " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT count(*) FROM prof) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_nulls,
 count(DISTINCT {c}) AS n_distinct,
 (SELECT {cast} FROM prof WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {cast} DESC LIMIT 1) AS top_value,
 (SELECT count(*) FROM prof WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS top_count,
 {f'min({c})::DOUBLE' if is_num else 'NULL::DOUBLE'} AS min, {f'max({c})::DOUBLE' if is_num else 'NULL::DOUBLE'} AS max,
 {num_sql(f'avg({c})') if is_num else 'NULL::DOUBLE'} AS mean, {num_sql(assoc)} AS association FROM prof"""
        for c, is_num, cast, assoc in [
            ("age", True, "CAST(age AS VARCHAR)", "corr(age, target)"),
            ("sales_channel_id", True, "CAST(sales_channel_id AS VARCHAR)", "corr(sales_channel_id, target)"),
            ("club_member_status", False, "club_member_status",
             "(SELECT sum(n * pow(m - (SELECT avg(target) FROM prof WHERE club_member_status IS NOT NULL), 2)) FROM (SELECT count(*) AS n, avg(target) AS m FROM prof WHERE club_member_status IS NOT NULL GROUP BY club_member_status)) / (SELECT var_pop(target) * count(*) FROM prof WHERE club_member_status IS NOT NULL)"),
            ("product_type_name", False, "product_type_name",
             "(SELECT sum(n * pow(m - (SELECT avg(target) FROM prof), 2)) FROM (SELECT count(*) AS n, avg(target) AS m FROM prof GROUP BY product_type_name)) / (SELECT var_pop(target) * count(*) FROM prof)"),
        ]),
        f"""prof AS MATERIALIZED (SELECT CASE WHEN raw_customers.age IS NOT NULL THEN raw_customers.age END AS age, sales_channel_id,
 raw_customers.club_member_status, product_type_name, CAST({unit('txn_id', salt='label')} < 0.3 AS INTEGER) AS target
 FROM transactions JOIN raw_customers USING (customer_id) JOIN articles USING (article_id))"""),
)
def table_profile(spark, sf):
    from vitrine.functions.scalars import hash_unit

    wide = E.enrich(T.transactions(spark, sf), T.raw_customers(spark, sf), T.articles(spark, sf))
    frame = wide.select(
        "age", "sales_channel_id", "club_member_status", "product_type_name",
        (hash_unit("txn_id", salt="label") < 0.3).cast("int").alias("target"),
    )
    return with_nums(A.table_profile(frame, "target"), ["mean", "association"])
