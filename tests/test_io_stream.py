import json

import pytest
from pyspark.sql import functions as F

from vitrine.operators.features import transaction_features
from vitrine.session import materialize, run_dir
from vitrine.sources import io, schemas
from vitrine.streaming.refresh import latest_features, refresh_stream


def test_csv_keeps_leading_zeros_and_dates(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("t_dat,customer_id,article_id,price,sales_channel_id\n2020-01-01,00c,0663713001,0.05,2\n2020-02-01,00d,07,0.1,1\n")
    df = io.read_transactions(spark, str(path), ["t_dat", "article_id", "price"], since="2020-01-15")
    assert [tuple(map(str, r)) for r in df.collect()] == [("2020-02-01", "07", "0.1")]
    assert io.read_transactions(spark, str(path)).count() == 2


def test_declared_null_text(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("customer_id,FN,Active,club_member_status,fashion_news_frequency,age,postal_code\nc1,,1.0,ACTIVE,None,24,p\n")
    plain = io.read_csv(spark, str(path), schemas.CUSTOMERS).first()
    assert plain.FN is None and plain.fashion_news_frequency == "None" and plain.age == 24.0
    assert io.read_csv(spark, str(path), schemas.CUSTOMERS, null_value="None").first().fashion_news_frequency is None


def test_season_map(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"winter_autumn": ["Coat", "Hat/beanie"], "summer_spring": ["Top"], "all_seasons": []}, indent=2))
    got = {tuple(r) for r in io.read_season_map(spark, str(path)).collect()}
    assert got == {("winter_autumn", "Coat"), ("winter_autumn", "Hat/beanie"), ("summer_spring", "Top")}


def test_json_records(spark):
    df = spark.createDataFrame([("1", None, 0.5), ("2", "x", 0.25)], schemas.SEARCH_RESULT)
    path = run_dir(spark, "json")
    io.write_json(df, path)
    assert sorted(map(tuple, io.read_json(spark, path, schemas.SEARCH_RESULT).collect())) == [("1", None, 0.5), ("2", "x", 0.25)]


def test_stage_depends_on_parameters(spark):
    base, built = run_dir(spark, "stages"), []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert io.stage(spark, "s", lambda: build(3), base, {"n": 3}).count() == 3
    assert io.stage(spark, "s", lambda: build(9), base, {"n": 3}).count() == 3
    assert io.stage(spark, "s", lambda: build(5), base, {"n": 5}).count() == 5
    assert io.stage(spark, "s", lambda: build(4), base, {"n": 5}, overwrite=True).count() == 4
    assert built == [3, 5, 4]


def test_stage_depends_on_its_input_files(spark):
    base, source, built = run_dir(spark, "stages"), run_dir(spark, "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(source)

    def stage():
        return io.stage(spark, "s", build, base, {"n": 3}, inputs=[source]).count()

    spark.range(3).write.parquet(source)
    assert (stage(), stage(), len(built)) == (3, 3, 1)
    spark.range(4).write.mode("append").parquet(source)
    assert (stage(), stage(), len(built)) == (7, 7, 2)
    # the older files are gone
    spark.range(10, 15).repartition(1).write.mode("overwrite").parquet(source)
    assert (stage(), len(built)) == (5, 3)


def test_embeddings_pack_and_coverage(spark):
    wide = spark.createDataFrame([("1", 0.5, 1.0)], "article_id string, e_0 double, e_1 double")
    emb = io.pack_embeddings(wide, "e_", 2)
    arts = spark.createDataFrame([("1",), ("2",)], "article_id string")
    joined = io.attach_embeddings(arts, emb)
    assert {r.article_id: r.embedding for r in joined.collect()} == {"1": [0.5, 1.0], "2": None}
    assert tuple(io.embedding_coverage(joined).first()) == (1, 1)


def test_materialize_reads_back(spark):
    assert materialize(spark.range(7), "m").agg(F.sum("id")).first()[0] == 21


def test_stream_equals_batch_with_late_rows(spark, tx):
    rows = [("c1", "a", d, d + 1) for d in range(12)] + [("c2", "b", d, 1) for d in (0, 9)]
    df = tx(rows)
    source, sink = run_dir(spark, "src"), run_dir(spark, "sink")
    # the second file holds older days than the first
    df.where("t_dat > '2020-01-05'").coalesce(1).write.parquet(source)
    df.where("t_dat <= '2020-01-05'").coalesce(1).write.mode("append").parquet(source)
    refresh_stream(spark, source, lambda: df, sink, run_dir(spark, "cp"))
    got = latest_features(spark, sink)
    want = transaction_features(df)
    cols = want.columns
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.collect()))


def test_work_dir_reads_the_session_setting(spark):
    from vitrine.session import work_dir

    assert work_dir(spark)
    with pytest.raises(Exception):
        spark.read.parquet(run_dir(spark, "absent")).count()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from vitrine.session import work_dir

    made = []
    context = SimpleNamespace(
        master="spark://head:7077", getConf=lambda: SimpleNamespace(get=lambda k: None),
        getCheckpointDir=lambda: None, setCheckpointDir=made.append,
    )
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(session)
    context.master = "local[2]"
    assert work_dir(session) == made[0]
    session.conf.get = lambda k, d: "hdfs://shared/"
    context.master = "yarn"
    assert work_dir(session) == "hdfs://shared"
