"""Refresh the features of customers touched by newly arrived transactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.streaming.feature_store import BACKFILL, FeatureStore

BUCKETS = 64


def refresh_stream(
    spark: SparkSession,
    source: str,
    history: Callable[[], DataFrame] | None,
    sink: str,
    checkpoint: str,
    files_per_batch: int = 1,
    buckets: int = BUCKETS,
) -> FeatureStore:
    """Run all waiting files of ``source`` through and stop.

    ``history`` fills the store before its first batch; later runs do not read it again. Each
    micro-batch reads and replaces the buckets of the customers it names, nothing else. Late rows need
    no watermark, because a named customer is recomputed whole. Sink and checkpoint commit
    by batch number, so a repeated batch changes nothing.
    """
    store = FeatureStore(spark, sink, buckets)
    schema = spark.read.parquet(source).schema
    if history is not None:
        store.apply(history().select(schema.names), BACKFILL)
    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    query = (
        arriving.writeStream.foreachBatch(store.apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store


def latest_features(spark: SparkSession, sink: str, buckets: int = BUCKETS) -> DataFrame:
    """Current features: every transaction once."""
    return FeatureStore(spark, sink, buckets).current()
