"""Row numbers and running totals over whole tables without a one-task window.

A window with no partition key sends every row through one task. Both helpers instead
cut the rows by the leading hex digits of an md5 key: the digest is uniform, so the
buckets are even, and its order is the order of the rows. Only the table of bucket totals
(at most ``16 ** digits`` rows per group) is summed in order; the rows themselves are
numbered inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_bucket(df: DataFrame, key: Column, digits: int) -> DataFrame:
    hashed = df.withColumn("_digest", F.md5(key.cast("string")))
    return hashed.withColumn("_bucket", F.substring("_digest", 1, digits))


def _bucket_offsets(bucketed: DataFrame, by: list[str], weight: Column) -> DataFrame:
    sums = bucketed.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_in_bucket"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *by, "_bucket", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_offset")
    )


def hashed_index(
    df: DataFrame, key: str, by: list[str] | None = None, idx: str = "idx", digits: int = 3
) -> DataFrame:
    """Number the rows of each ``by`` group 0, 1, 2 ... in md5 order of the unique ``key``."""
    by = by or []
    bucketed = _with_bucket(df, F.col(key), digits)
    offsets = _bucket_offsets(bucketed, by, F.lit(1))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_digest", key)
    return (
        bucketed.join(offsets, [*by, "_bucket"])
        .withColumn(idx, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_digest", "_offset")
    )


def hashed_running_total(
    df: DataFrame, key: str, weight: str, start: str = "start", digits: int = 3
) -> DataFrame:
    """Sum of ``weight`` over all rows before this one in md5 order of the unique ``key``."""
    bucketed = _with_bucket(df, F.col(key), digits)
    offsets = _bucket_offsets(bucketed, [], F.col(weight))
    before = (
        Window.partitionBy("_bucket")
        .orderBy("_digest", key)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        bucketed.join(offsets, "_bucket")
        .withColumn(start, F.col("_offset") + F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .drop("_bucket", "_digest", "_offset")
    )
