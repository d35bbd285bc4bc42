"""Sellers, earnings, shares, distributions and customer segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import analytics as A
from vitrine.operators.clean import week_index
from vitrine.functions.scalars import age_groups, age_interval
from vitrine.plans.oracle import sql
from vitrine.plans.registry import money, money_sql, num, num_sql, query, with_nums
from vitrine.sources import testdata as T
from vitrine.sources.schemas import FACETS

SOLD = "SELECT article_id, count(*) AS sold_qty FROM transactions GROUP BY article_id"
EARNED = "SELECT article_id, sum(price) AS earning FROM transactions GROUP BY article_id"
TOP_SOLD = f"SELECT * FROM ({SOLD}) ORDER BY sold_qty DESC, article_id LIMIT {{n}}"
TOP_EARN = f"SELECT * FROM ({EARNED}) ORDER BY earning DESC, article_id LIMIT {{n}}"
FLOP_EARN = f"SELECT * FROM ({EARNED}) ORDER BY earning, article_id DESC LIMIT {{n}}"
LOWEST = f"SELECT * FROM ({SOLD}) WHERE sold_qty = (SELECT min(sold_qty) FROM ({SOLD}))"
DETAIL_COLS = ["article_id", "prod_name", "product_type_name", "product_group_name", "colour_group_name", "index_name"]


@query("sold_qty_by_article", sql("transactions", SOLD))
def sold_qty_by_article(spark, sf):
    return A.sold_qty(T.transactions(spark, sf))


@query("earnings_by_article", sql("transactions", f"SELECT article_id, {money_sql('earning')} AS earning FROM ({EARNED})"))
def earnings_by_article(spark, sf):
    return A.earnings(T.transactions(spark, sf)).withColumn("earning", money("earning"))


@query(
    "total_earnings",
    sql("transactions", f"SELECT count(*) AS n_articles, {money_sql('sum(earning)')} AS total_earning FROM ({EARNED})"),
)
def total_earnings(spark, sf):
    out = A.total_earnings(T.transactions(spark, sf))
    return out.withColumn("total_earning", money("total_earning"))


@query(
    "customer_totals",
    sql("transactions", f"SELECT customer_id, {money_sql('sum(price)')} AS earning, count(article_id) AS qty FROM transactions GROUP BY customer_id"),
)
def customer_totals(spark, sf):
    return A.customer_totals(T.transactions(spark, sf)).withColumn("earning", money("earning"))


CUST_DETAILS = """SELECT t.*, c.* EXCLUDE (customer_id, postal_code), CASE WHEN age > 16 AND age <= 20 THEN '16-20'
 WHEN age > 20 AND age <= 30 THEN '20-30' WHEN age > 30 AND age <= 40 THEN '30-40'
 WHEN age > 40 AND age <= 50 THEN '40-50' WHEN age > 50 AND age <= 60 THEN '50-60'
 WHEN age > 60 AND age <= 70 THEN '60-70' WHEN age > 70 THEN '70+' END AS age_groups
FROM (SELECT customer_id, sum(price) AS earning, count(*) AS qty FROM transactions GROUP BY customer_id) t
JOIN raw_customers c USING (customer_id)"""
DETAILS_CTE = f"details AS ({CUST_DETAILS})"


def _details(spark, sf):
    return A.customer_details(T.transactions(spark, sf), T.raw_customers(spark, sf))


@query(
    "customer_details",
    sql("transactions raw_customers", f"SELECT * REPLACE ({money_sql('earning')} AS earning) FROM details", DETAILS_CTE),
)
def customer_details(spark, sf):
    return _details(spark, sf).withColumn("earning", money("earning"))


def _describe_sql(views, inner, col, extra=""):
    stats = {
        "count": f"count({col})::DOUBLE", "mean": f"avg({col})", "std": f"stddev_samp({col})",
        "min": f"min({col})::DOUBLE", "max": f"max({col})::DOUBLE",
        "25%": f"quantile_cont({col}, 0.25)", "50%": f"quantile_cont({col}, 0.5)", "75%": f"quantile_cont({col}, 0.75)",
    }
    body = " UNION ALL ".join(
        f"SELECT '{k}' AS stat, {num_sql(v + '::DOUBLE')} AS value FROM ({inner})" for k, v in stats.items()
    )
    return sql(views, body, extra)


@query("describe_sold_qty", _describe_sql("transactions", SOLD, "sold_qty"))
def describe_sold_qty(spark, sf):
    return with_nums(A.describe(A.sold_qty(T.transactions(spark, sf)), "sold_qty"), ["value"])


@query("describe_customer_qty", _describe_sql("transactions raw_customers", "SELECT qty FROM details", "qty", DETAILS_CTE))
def describe_customer_qty(spark, sf):
    return with_nums(A.describe(_details(spark, sf), "qty"), ["value"])


QS = [0.90, 0.95, 0.99, 0.999]


@query(
    "sold_qty_quantiles",
    sql("transactions", " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS p, {num_sql(f'quantile_cont(sold_qty, {p})')} AS quantile FROM ({SOLD})" for p in QS
    )),
)
def sold_qty_quantiles(spark, sf):
    qty = A.sold_qty(T.transactions(spark, sf))
    return with_nums(A.quantiles(qty, "sold_qty", QS), ["quantile"])


# ---- top and bottom sets and their shares -------------------------------------------


def _top_sold(spark, sf, n=100):
    return A.top_n(A.sold_qty(T.transactions(spark, sf)), "sold_qty", n)


def _top_earning(spark, sf, n=100):
    return A.top_n(A.earnings(T.transactions(spark, sf)), "earning", n)


def _flop_earning(spark, sf, n=100):
    return A.bottom_n(A.earnings(T.transactions(spark, sf)), "earning", n)


def _sold_least(spark, sf):
    """The articles sold as rarely as the rarest one: sold once, where that occurs."""
    qty = A.sold_qty(T.transactions(spark, sf))
    return A.sold_exactly(qty, qty.agg(F.min("sold_qty")).scalar())


@query("top100_sold", sql("transactions", TOP_SOLD.format(n=100)))
def top100_sold(spark, sf):
    return _top_sold(spark, sf)


@query("top100_earning", sql("transactions", f"SELECT article_id, {money_sql('earning')} AS earning FROM ({TOP_EARN.format(n=100)})"))
def top100_earning(spark, sf):
    return _top_earning(spark, sf).withColumn("earning", money("earning"))


@query("flop100_earning", sql("transactions", f"SELECT article_id, {money_sql('earning')} AS earning FROM ({FLOP_EARN.format(n=100)})"))
def flop100_earning(spark, sf):
    return _flop_earning(spark, sf).withColumn("earning", money("earning"))


@query("sold_n_times", sql("transactions", LOWEST))
def sold_n_times(spark, sf):
    return _sold_least(spark, sf)


@query(
    "top100_sold_details",
    sql("transactions articles", f"SELECT sold_qty, {', '.join(DETAIL_COLS)} FROM ({TOP_SOLD.format(n=100)}) JOIN articles USING (article_id)"),
)
def top100_sold_details(spark, sf):
    out = A.with_details(_top_sold(spark, sf), T.articles(spark, sf))
    return out.select("sold_qty", *DETAIL_COLS)


def _share(name, build, inner, attr, measure):
    total = f"sum({measure})"
    body = f"""SELECT {attr}, {money_sql(total)} AS {measure},
 {num_sql(f'{total} / sum({total}) OVER () * 100')} AS share_pct
FROM ({inner}) JOIN articles USING (article_id) WHERE {attr} IS NOT NULL GROUP BY {attr}"""
    if measure == "sold_qty":
        body = body.replace(f"{money_sql(total)} AS", f"CAST({total} AS BIGINT) AS")

    @query(name, sql("transactions articles", body))
    def shares(spark, sf):
        out = A.share_by(A.with_details(build(spark, sf), T.articles(spark, sf)), attr, measure)
        out = out if measure == "sold_qty" else out.withColumn(measure, money(measure))
        return with_nums(out, ["share_pct"])


ATTRS = {"type": "product_type_name", "index": "index_name", "colour": "colour_group_name", "group": "product_group_name"}
_share("top30_share_prod_name", lambda s, d: _top_sold(s, d, 30), TOP_SOLD.format(n=30), "prod_name", "sold_qty")
_share("top50_earning_share_prod_name", lambda s, d: _top_earning(s, d, 50), TOP_EARN.format(n=50), "prod_name", "earning")
for _short, _attr in ATTRS.items():
    _share(f"top100_share_{_short}", _top_sold, TOP_SOLD.format(n=100), _attr, "sold_qty")
    _share(f"sold_once_share_{_short}", _sold_least, LOWEST, _attr, "sold_qty")
    _share(f"top100_earning_share_{_short}", _top_earning, TOP_EARN.format(n=100), _attr, "earning")
    _share(f"flop100_share_{_short}", _flop_earning, FLOP_EARN.format(n=100), _attr, "earning")


NS = [10, 50, 100, 200, 300, 400, 1000]


@query(
    "earning_concentration",
    sql("transactions", f"""SELECT CAST(n AS INTEGER) AS top_n, {num_sql('sum(earning) FILTER (rn <= n) / sum(earning) * 100')} AS percent
FROM (SELECT earning, row_number() OVER (ORDER BY earning DESC, article_id) AS rn FROM ({EARNED}))
CROSS JOIN (SELECT unnest({NS}) AS n) GROUP BY n"""),
)
def earning_concentration(spark, sf):
    out = A.concentration(A.earnings(T.transactions(spark, sf)), "earning", NS)
    return with_nums(out, ["percent"])


# ---- customer segments ---------------------------------------------------------------


def _segment_share(name, attr, measure):
    body = f"""SELECT {attr}, round(sum({measure}), 2)::DOUBLE AS {measure},
 {num_sql(f'sum({measure}) / sum(sum({measure})) OVER () * 100')} AS share_pct
FROM details WHERE {attr} IS NOT NULL GROUP BY {attr}"""

    @query(name, sql("transactions raw_customers", body, DETAILS_CTE))
    def shares(spark, sf):
        out = A.share_by(_details(spark, sf), attr, measure)
        return with_nums(out.withColumn(measure, money(F.col(measure).cast("double"))), ["share_pct"])


_segment_share("qty_share_age", "age_groups", "qty")
_segment_share("earning_share_age", "age_groups", "earning")
_segment_share("qty_share_news", "fashion_news_frequency", "qty")


@query(
    "news_share_within_age",
    sql("transactions raw_customers", f"""SELECT * FROM (
SELECT age_groups, fashion_news_frequency, {num_sql('count(*) / sum(count(*)) OVER (PARTITION BY age_groups) * 100')} AS percent
FROM details WHERE age_groups IS NOT NULL AND fashion_news_frequency IS NOT NULL GROUP BY age_groups, fashion_news_frequency)
WHERE fashion_news_frequency IN ('Regularly', 'NONE')""", DETAILS_CTE),
)
def news_share_within_age(spark, sf):
    out = A.share_within(_details(spark, sf), "age_groups", "fashion_news_frequency", ["Regularly", "NONE"])
    return with_nums(out, ["percent"])


@query(
    "club_status_share",
    sql("transactions raw_customers", f"""SELECT club_member_status, {num_sql('count(*) / sum(count(*)) OVER ()')} AS share
FROM details WHERE club_member_status IS NOT NULL GROUP BY ALL""", DETAILS_CTE),
)
def club_status_share(spark, sf):
    return with_nums(A.value_share(_details(spark, sf), "club_member_status"), ["share"])


_STATS = f"sum(qty)::DOUBLE AS total, {num_sql('avg(qty)')} AS mean, {num_sql('median(qty)')} AS median, CAST(trunc(avg(qty)) AS INTEGER) AS mean_int"


@query(
    "club_status_stats",
    sql("transactions raw_customers", f"""SELECT club_member_status, {_STATS} FROM details WHERE club_member_status IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'ALL' AS club_member_status, {_STATS} FROM details""", DETAILS_CTE),
)
def club_status_stats(spark, sf):
    out = A.segment_stats(_details(spark, sf), "club_member_status", "qty")
    return with_nums(out, ["mean", "median"])


@query(
    "age_histogram",
    sql("transactions raw_customers", """SELECT CAST(least(floor((age - lo) / ((hi - lo) / 70)), 69) AS INTEGER) AS bin, count(*) AS n
FROM details CROSS JOIN (SELECT min(age) AS lo, max(age) AS hi FROM details) WHERE age IS NOT NULL GROUP BY ALL""", DETAILS_CTE),
)
def age_histogram(spark, sf):
    return A.histogram(_details(spark, sf), "age", 70)


def _kde_sql(views, inner, col, extra=""):
    return sql(
        views,
        f"""SELECT CAST(point AS INTEGER) AS point, {num_sql('x')} AS x,
 round(sum(exp(-0.5 * pow((x - v) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())) * 1e6 + 3.3e-8, 6) AS density_e6
FROM (SELECT v, bw, n, point, lo - 3 * bw + point * ((hi - lo + 6 * bw) / 199) AS x FROM vals
 CROSS JOIN (SELECT count(v) AS n, min(v) AS lo, max(v) AS hi, pow(count(v), -0.2) * stddev_samp(v) AS bw FROM vals)
 CROSS JOIN (SELECT unnest(range(200)) AS point)) GROUP BY point, x""",
        (extra + ", " if extra else "") + f"vals AS (SELECT {col}::DOUBLE AS v FROM ({inner}) WHERE {col} IS NOT NULL)",
    )


def _kde(df, col):
    out = A.kde(df, col)
    return out.select("point", num("x").alias("x"), num(F.col("density") * 1e6).alias("density_e6"))


@query("sold_qty_kde", _kde_sql("transactions", SOLD, "sold_qty"))
def sold_qty_kde(spark, sf):
    return _kde(A.sold_qty(T.transactions(spark, sf)), "sold_qty")


@query("customer_qty_kde", _kde_sql("transactions raw_customers", "SELECT qty FROM details", "qty", DETAILS_CTE))
def customer_qty_kde(spark, sf):
    return _kde(_details(spark, sf), "qty")


@query(
    "activity_value_kde",
    sql("activity", f"""SELECT CAST(point AS INTEGER) AS point, {num_sql('lo + point * step')} AS x,
 round(sum(w * exp(-0.5 * pow((point * step - cell * fine) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())) * 1e6 + 3.3e-8, 6) AS density_e6
FROM points CROSS JOIN (SELECT unnest(range(200)) AS point) CROSS JOIN shape GROUP BY point, lo, step""",
        """vals AS (SELECT price::DOUBLE AS v FROM activity WHERE price IS NOT NULL),
shape AS MATERIALIZED (SELECT *, lo0 - 3 * bw AS lo, (hi0 - lo0 + 6 * bw) / 4095 AS fine, (hi0 - lo0 + 6 * bw) / 199 AS step FROM (
  SELECT count(v) AS n, min(v) AS lo0, max(v) AS hi0, pow(count(v), -0.2) * stddev_samp(v) AS bw FROM vals)),
placed AS (SELECT floor((v - lo) / fine) AS cell, (v - lo) / fine AS place FROM vals CROSS JOIN shape),
points AS MATERIALIZED (SELECT cell, sum(w) AS w FROM (SELECT cell, 1 - (place - cell) AS w FROM placed
  UNION ALL SELECT cell + 1 AS cell, place - cell AS w FROM placed) GROUP BY cell)"""),
)
def activity_value_kde(spark, sf):
    """Density of a column whose values are all distinct, from a mesh."""
    out = A.kde_binned(T.activity(spark, sf), "price")
    return out.select("point", num("x").alias("x"), num(F.col("density") * 1e6).alias("density_e6"))



@query("age_interval_counts", sql("customers", "SELECT age_interval, count(*) AS n FROM customers GROUP BY ALL"))
def age_interval_counts(spark, sf):
    from vitrine.operators.clean import impute_median

    ages = impute_median(T.raw_customers(spark, sf), "age")
    return ages.groupBy(age_interval("age").alias("age_interval")).agg(F.count("*").alias("n"))


@query(
    "age_group_counts",
    sql("transactions raw_customers", "SELECT COALESCE(age_groups, 'none') AS age_groups, count(*) AS n FROM details GROUP BY ALL", DETAILS_CTE),
)
def age_group_counts(spark, sf):
    buyers = T.transactions(spark, sf).select("customer_id").distinct()
    ages = T.raw_customers(spark, sf).join(buyers, "customer_id", "left_semi")
    return ages.groupBy(F.coalesce(age_groups("age"), F.lit("none")).alias("age_groups")).agg(
        F.count("*").alias("n")
    )


@query(
    "sales_by_week",
    sql("transactions", f"""SELECT CAST(date_diff('day', (SELECT min(t_dat) FROM transactions), t_dat) // 7 AS INTEGER) AS week,
 count(*) AS n, {money_sql('sum(price)')} AS earning FROM transactions GROUP BY ALL"""),
)
def sales_by_week(spark, sf):
    weeks = week_index(T.transactions(spark, sf))
    return weeks.groupBy("week").agg(F.count("*").alias("n"), money(F.sum("price")).alias("earning"))


@query(
    "facet_options",
    sql("articles", " UNION ".join(f"SELECT '{k}' AS facet, {c} AS value FROM articles WHERE {c} IS NOT NULL" for k, c in FACETS.items())),
)
def facet_options(spark, sf):
    return A.facet_rows(T.articles(spark, sf), FACETS)
