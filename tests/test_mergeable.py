"""Statistics by day and month against the exact features of the same days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import features as E
from vitrine.operators import mergeable as M
from vitrine.session import run_dir

CATEG, CONTI = ["customer_id"], ["price"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = [
        (f"c{r.randint(0, 30)}", f"a{r.choice([0, 0, 0, r.randint(0, 9)])}", dt.date(2020, 1, 10) + dt.timedelta(days=r.randint(0, 140)), r.randint(1, 9_999) / 100, str(i))
        for i in range(1500)
    ]
    data += [("c1", "one", dt.date(2020, 2, 1), 5.0, "x"), ("c1", "same", dt.date(2020, 2, 1), 60000.1, "y"), ("c1", "same", dt.date(2020, 3, 1), 60000.1, "z")]
    data += [("c1", "none", dt.date(2020, 2, 1), None, "n")]
    return spark.createDataFrame(data, "customer_id string, article_id string, t_dat date, price double, txn_id string").cache()


def store(spark, **params):
    return M.StatisticsStore(spark, run_dir(spark, "stats"), "article_id", "art", CATEG, CONTI, **params)


def same(got, want):
    cols = sorted(want.columns)
    cells = lambda df: {r["article_id"]: [r[c] if isinstance(r[c], str) or r[c] is None else pytest.approx(r[c], rel=1e-12, abs=1e-9) for c in cols] for r in df.collect()}
    assert cells(got) == cells(want)


def between(df, since, until):
    return df.where(F.col("t_dat").between(F.lit(since).cast("date"), F.lit(until).cast("date")))


RANGES = [("2020-01-01", "2020-12-31"), ("2020-02-01", "2020-02-29"), ("2020-01-20", "2020-04-11"), ("2020-02-03", "2020-02-20"), ("2020-02-15", "2020-03-15"), ("2020-03-01", "2020-04-02")]


@pytest.mark.parametrize("since,until", RANGES)
def test_ranges_equal_the_exact_features(spark, rows, since, until):
    s = store(spark, unit_days=7 if since > "2020-01-25" else 1)
    s.put(rows)
    same(s.features(since, until), E.entity_features(between(rows, since, until), "article_id", "art", CATEG, CONTI))


def test_whole_months_are_read_as_months(spark, rows):
    s = store(spark)
    s.put(rows)
    files = s.parts("2020-01-20", "2020-04-11").inputFiles()
    months = {f.split("month=")[1].split("/")[0] for f in files if "month=" in f}
    assert {"2020-02", "2020-03"} <= months
    text = s.parts("2020-01-20", "2020-04-11")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "month" in text and "unit" in text


def test_a_day_that_arrives_leaves_older_days_alone(spark, rows):
    import os

    s = store(spark)
    early = rows.where("t_dat < '2020-03-15'")
    s.put(early)
    base = s.path.removeprefix("file:")
    stamps = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")}
    before = stamps()
    day = rows.where("t_dat = '2020-03-15'")
    assert day.count()
    s.put(day)
    after = stamps()
    changed = {f for f in after if before.get(f) != after[f]} | (set(before) - set(after))
    assert all("unit=2020-03-15" in f or "month=2020-03" in f for f in changed)
    same(s.features("2020-01-01", "2020-12-31"), E.entity_features(rows.where("t_dat <= '2020-03-15'"), "article_id", "art", CATEG, CONTI))
    # The same day again is replaced, not added.
    s.put(day)
    same(s.features("2020-01-01", "2020-12-31"), E.entity_features(rows.where("t_dat <= '2020-03-15'"), "article_id", "art", CATEG, CONTI))


def test_equal_values_have_no_deviation(spark, rows):
    s = store(spark)
    s.put(rows)
    got = {r["article_id"]: r["art_price_std"] for r in s.features("2020-01-01", "2020-12-31").collect()}
    assert got["same"] == 0.0 and got["one"] == 0.0 and got["none"] == 0.0


def test_distinct_counts_are_within_the_stated_error(spark):
    many = spark.range(60_000).select(
        (F.col("id") % 40_000).cast("string").alias("customer_id"), F.lit("a").alias("article_id"),
        F.expr("date_add(date'2020-01-01', int(id % 50))").alias("t_dat"), F.lit(1.0).alias("price"),
    )
    for lg_k in (10, 12):
        s = store(spark, lg_k=lg_k)
        s.put(many)
        got = s.features("2020-01-01", "2020-12-31").first()["art_nb_customer_id"]
        assert abs(got / 40_000 - 1) < 4 * 1.04 / 2 ** (lg_k / 2)


def test_empty_range(spark, rows):
    s = store(spark)
    s.put(rows)
    assert s.features("2021-01-05", "2021-02-20").count() == 0


def test_sets_count_like_distinct(rows):
    exact = E.entity_features(rows, "article_id", "art", ["customer_id", "txn_id"], CONTI)
    sets = E.entity_features(rows, "article_id", "art", ["customer_id", "txn_id"], CONTI, ["customer_id"])
    same(sets, exact)
    text = E.entity_features(rows, "article_id", "art", ["customer_id"], CONTI, ["customer_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text
