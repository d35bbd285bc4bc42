"""The incremental feature store: what it reads, replaces, repeats and survives."""

import os

import pytest
from pyspark.sql import functions as F

from vitrine.operators.features import transaction_features
from vitrine.session import run_dir
from vitrine.streaming.feature_store import FeatureStore


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def files(store):
    base = store.path.removeprefix("file:")
    found = {}
    for folder, _, names in os.walk(f"{base}/rows"):
        for n in names:
            if n.endswith(".parquet"):
                found[f"{folder}/{n}"] = os.stat(f"{folder}/{n}").st_mtime_ns
    return found


@pytest.fixture
def store(spark):
    return FeatureStore(spark, run_dir(spark, "store"), buckets=8)


@pytest.fixture
def all_rows(tx):
    return tx([(f"c{c}", f"a{(c + d) % 5}", d, c + d) for c in range(12) for d in range(0, 40, 3)])


def test_batches_in_any_order_equal_one_batch(store, all_rows):
    want = rows(transaction_features(all_rows))
    parts = ["t_dat > '2020-01-20'", "t_dat <= '2020-01-04'", "t_dat > '2020-01-04' and t_dat <= '2020-01-20'"]
    for i, part in enumerate(parts):
        store.apply(all_rows.where(part), i)
    assert rows(store.current()) == want


def test_a_batch_reads_and_replaces_its_buckets_only(spark, store, all_rows, tx, monkeypatch):
    store.apply(all_rows, 0)
    before, (_, slots) = files(store), store.manifest()
    asked = []
    read = FeatureStore._read
    monkeypatch.setattr(FeatureStore, "_read", lambda self, s, b: asked.append(set(b)) or read(self, s, b))
    one = tx([("c3", "a1", 50, 9)]).withColumn("txn_id", F.lit("new"))
    bucket = one.select(store.bucket_of("customer_id")).first()[0]
    store.apply(one, 1)
    assert asked == [{bucket}]
    after, (_, now) = files(store), store.manifest()
    assert {b for b in now if now[b] != slots[b]} == {bucket}
    untouched = {f: t for f, t in after.items() if f"bucket={bucket}/" not in f}
    assert untouched == {f: t for f, t in before.items() if f"bucket={bucket}/" not in f}
    scan = store._read(now, {bucket})
    assert scan.inputFiles() and all(f"bucket={bucket}/slot={now[bucket]}/" in f for f in scan.inputFiles())
    assert rows(store.current()) == rows(transaction_features(all_rows.unionByName(one)))


def test_a_repeated_batch_changes_nothing(store, all_rows):
    store.apply(all_rows.where("t_dat <= '2020-01-09'"), 0)
    store.apply(all_rows.where("t_dat > '2020-01-09'"), 1)
    before, kept = files(store), rows(store.current())
    store.apply(all_rows.where("t_dat > '2020-01-09'"), 1)
    store.apply(all_rows.where("t_dat <= '2020-01-09'"), 0)
    assert files(store) == before
    # The same transactions in a new batch are known by their key.
    store.apply(all_rows, 2)
    assert rows(store.current()) == kept
    assert store.current().groupBy("txn_id").count().where("count > 1").count() == 0


def test_a_batch_that_broke_off_is_not_seen_and_runs_again(store, all_rows, monkeypatch):
    old, new = all_rows.where("t_dat <= '2020-01-09'"), all_rows.where("t_dat > '2020-01-09'")
    store.apply(old, 0)
    kept = rows(store.current())

    def broken(self, batch_id, slots):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(FeatureStore, "_commit", broken)
        with pytest.raises(RuntimeError):
            store.apply(new, 1)
    assert rows(store.current()) == kept
    store.apply(new, 1)
    assert rows(store.current()) == rows(transaction_features(all_rows))


def test_lookup_reads_the_buckets_asked_for(spark, store, all_rows):
    store.apply(all_rows, 0)
    asked = spark.createDataFrame([("c3",), ("c5",), ("nobody",)], "customer_id string")
    want = transaction_features(all_rows).where("customer_id in ('c3', 'c5')")
    found = store.lookup(asked)
    assert rows(found) == rows(want)
    held = {r[0] for r in asked.select(store.bucket_of("customer_id")).collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in found.inputFiles() if "bucket=" in f} <= held
    assert store.lookup(asked.where("false")).count() == 0


def test_empty_batches_and_wrong_bucket_numbers(spark, store, all_rows):
    with pytest.raises(ValueError):
        store.current()
    store.apply(all_rows.limit(0), 0)
    assert store.manifest() == (0, {})
    store.apply(all_rows, 1)
    store.apply(all_rows.limit(0), 2)
    assert rows(store.current()) == rows(transaction_features(all_rows))
    with pytest.raises(ValueError):
        FeatureStore(spark, store.path, buckets=16).current()
