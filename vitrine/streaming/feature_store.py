"""Features by customer bucket, replaced bucket by bucket as transactions arrive.

The store is one table: every transaction once, with its features, in the folder of its customer's
bucket. Each bucket has two slots, of which the manifest names the current one. A batch reads the current slots of
the buckets it touches and no other, recomputes the customers it names, writes the other slot of those
buckets and then the manifest. The manifest is a single file, so readers see all of a batch or nothing of it; it has two
slots of its own and holds one row a bucket. A batch that was committed already is left alone, one that
broke off before its commit writes the same slots again. Twice the size of the table is the most that is stored.

A transaction of a bucket that arrives again, by its key, is dropped: the row that came first stays, and of
several in one batch the smallest.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.features import keep_keys, transaction_features
from vitrine.sources.schemas import ROLLING_FEATURES

MANIFEST = "bucket int, slot int, batch long, buckets int"
#: The batch number of what the store is filled with before the first batch.
BACKFILL = -1


class FeatureStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    # ---- what is there ------------------------------------------------------------

    def bucket_of(self, customer: Column | str) -> Column:
        return F.pmod(F.xxhash64(customer), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int | None, dict[int, int]]:
        """The last committed batch, and the current slot of every bucket that holds rows."""
        newest, slots = None, {}
        for slot in (0, 1):
            try:
                rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/slot={slot}").collect()
            except AnalysisException:  # not written yet, or being written
                continue
            if rows and (newest is None or rows[0]["batch"] > newest):
                newest, slots = rows[0]["batch"], {r["bucket"]: r["slot"] for r in rows if r["bucket"] is not None}
                if rows[0]["buckets"] != self.buckets:
                    raise ValueError(f"the store has {rows[0]['buckets']} buckets, not {self.buckets}")
        return newest, slots

    def _folders(self, slots: dict[int, int], buckets: Iterable[int]) -> list[str]:
        return [f"{self.path}/rows/bucket={b}/slot={slots[b]}" for b in sorted(buckets) if b in slots]

    def _read(self, slots: dict[int, int], buckets: Iterable[int]) -> DataFrame | None:
        """Rows of these buckets; folders of other buckets are not even listed."""
        folders = self._folders(slots, buckets)
        if not folders:
            return None
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*folders).drop("bucket", "slot")

    def current(self) -> DataFrame:
        """All transactions with their features."""
        _, slots = self.manifest()
        rows = self._read(slots, slots)
        if rows is None:
            raise ValueError(f"nothing is stored in {self.path} yet")
        return rows

    def lookup(self, customers: DataFrame) -> DataFrame:
        """Rows of some customers (a column ``customer_id``), read from their buckets only."""
        _, slots = self.manifest()
        held = self._buckets_of(customers) & set(slots)
        rows = self._read(slots, held)
        return self.current().where("false") if rows is None else keep_keys(rows, customers, "customer_id")

    def _buckets_of(self, rows: DataFrame) -> set[int]:
        """At most one number a bucket, however many rows there are."""
        return {r[0] for r in rows.select(self.bucket_of("customer_id")).distinct().collect()}

    # ---- what arrives ---------------------------------------------------------------

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one batch of transactions."""
        done, slots = self.manifest()
        if done is not None and batch_id <= done:
            return
        touched = self._buckets_of(batch)
        if touched:
            self._replace(batch, touched, slots)
            slots = slots | {b: 1 - slots.get(b, 1) for b in touched}
        self._commit(batch_id, slots)

    def _replace(self, batch: DataFrame, touched: set[int], slots: dict[int, int]) -> None:
        others = [c for c in batch.columns if c != "txn_id"]
        arrived = batch.groupBy("txn_id").agg(F.min(F.struct(*others)).alias("row")).select("txn_id", "row.*").select(batch.columns)
        stored = self._read(slots, touched)
        if stored is None:
            fresh, rest = transaction_features(arrived), None
        else:
            arrived = arrived.join(stored.select("txn_id"), "txn_id", "left_anti").select(batch.columns)
            named = arrived.select("customer_id").distinct()
            history = keep_keys(stored, named, "customer_id").select(batch.columns)
            fresh = transaction_features(history.unionByName(arrived))
            rest = stored.join(named, "customer_id", "left_anti")
        cols = [*batch.columns, *ROLLING_FEATURES]
        rows = fresh.select(cols) if rest is None else rest.select(cols).unionByName(fresh.select(cols))
        next_slot = F.create_map(*[F.lit(x) for b in sorted(touched) for x in (b, 1 - slots.get(b, 1))])
        rows = rows.withColumn("bucket", self.bucket_of("customer_id")).withColumn("slot", next_slot[F.col("bucket")])
        # Rebalancing joins small buckets and splits one that a single customer fills.
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("bucket", "slot").parquet(f"{self.path}/rows")

    def _commit(self, batch_id: int, slots: dict[int, int]) -> None:
        """Name the current slots; one row at least tells the batch."""
        rows = [(b, s, batch_id, self.buckets) for b, s in sorted(slots.items())] or [(None, None, batch_id, self.buckets)]
        held = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        held.write.mode("overwrite").parquet(f"{self.path}/manifest/slot={batch_id % 2}")
