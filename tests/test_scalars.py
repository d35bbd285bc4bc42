import datetime as dt

from pyspark.sql import functions as F

from vitrine.functions import scalars as S
from vitrine.operators.clean import clean_customers, seasonal_flag, split_by_date, week_index


def test_age_edges(spark):
    ages = [15, 16, 17, 20, 21, 25, 26, 65, 66, 71, None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, age int")
    rows = df.select("i", S.age_interval("age"), S.age_groups("age")).orderBy("i").collect()
    assert [r[1] for r in rows] == ["[16, 25]"] * 6 + ["[26, 35]", "[56, 65]"] + ["[66, 99]"] * 3
    assert [r[2] for r in rows] == [None, None, "16-20", "16-20", "20-30", "20-30", "20-30", "60-70", "60-70", "70+", None]


def test_keys_and_paths(spark):
    df = spark.createDataFrame([("0108775015",), ("7",), ("000",), (" 12 ",), ("12345678901",), ("",)], "k string")
    got = [tuple(r) for r in df.select(S.norm_key("k"), S.norm_key("k", 10), S.image_path("k")).collect()]
    assert got[0] == ("108775015", "0108775015", "/images/010/0108775015.jpg")
    assert got[1][:2] == ("7", "0000000007")
    assert got[2][0] == "0"
    assert got[3][0] == "12"
    assert got[4][1] == "12345678901"
    assert got[5][0] == ""


def test_season_is_seen_from_the_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 2, 29, 20, 0),)], "t timestamp_ntz").select(
        F.col("t").cast("timestamp").alias("t")
    )
    assert df.select(S.season_of("t", "Asia/Ho_Chi_Minh")).first()[0] == "summer_spring"
    assert df.select(S.season_of("t", "UTC")).first()[0] == "winter_autumn"


def test_customers_are_filled_and_imputed(spark):
    rows = [
        ("a", None, "1.0", None, "None", 20.0, "P1"),
        ("b", "1.0", None, "ACTIVE", None, None, "P2"),
        ("c", None, None, "ACTIVE", "Regularly", 41.0, "P3"),
    ]
    df = spark.createDataFrame(
        rows,
        "customer_id string, FN string, Active string, club_member_status string, "
        "fashion_news_frequency string, age double, postal_code string",
    )
    got = {r.customer_id: r for r in clean_customers(df).collect()}
    assert got["a"].FN == "UNKNOWN" and got["a"].fashion_news_frequency == "NONE"
    assert got["a"].club_member_status == "UNKNOWN"
    assert got["b"].fashion_news_frequency == "UNKNOWN" and got["b"].age == 30.5
    assert got["b"].age_interval == "[26, 35]"
    empty = clean_customers(df.limit(0))
    assert empty.count() == 0 and "age_interval" in empty.columns


def test_split_is_inclusive_and_may_be_open(tx):
    df = tx([("c", "a", d, 1) for d in range(10)])
    train, val = split_by_date(df, ("2020-01-02", "2020-01-04"), ("2020-01-06", "2020-01-07"))
    assert (train.count(), val.count()) == (3, 2)
    assert split_by_date(df, ("2020-01-02", "2020-01-04"), ("2020-01-03", None))[1].count() == 8


def test_weeks(tx):
    weeks = week_index(tx([("c", "a", d, 1) for d in (3, 9, 10, 17)])).orderBy("t_dat").collect()
    assert [r.week for r in weeks] == [0, 0, 1, 2]


def test_seasonal_flag(spark):
    arts = spark.createDataFrame([("1", "Coat"), ("2", "Top"), ("3", "Bag"), ("4", "?")], "article_id string, product_type_name string")
    seasons = spark.createDataFrame(
        [("winter_autumn", "Coat"), ("summer_spring", "Top"), ("all_seasons", "Bag")], "season string, product_type_name string"
    )
    got = seasonal_flag(arts, seasons, F.lit("2020-12-01").cast("date")).orderBy("article_id").collect()
    assert [r.is_seasonal for r in got] == [1, 0, 1, 0]
    assert got[3].seasonal_group == "unknown"
