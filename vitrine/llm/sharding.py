"""Contiguous shards of near equal bytes, cut from global prefix sums.

The rows are ordered by id, then by a hash of the text, and written once in range partitions of that
order; each row keeps its place there. Only the totals of the partitions are summed in order. A shard is
what lies between two equal targets: a row goes where the middle of its bytes falls, so a shard is off by
one document at most. A partition whose bytes all fall between two targets needs no more than its total;
the running sums of rows are taken in the other partitions alone, which are fewer than the shards.

Everything is DataFrame functions. The size of a document is its UTF-8 bytes plus one; a null text has no
bytes. Null ids come first. Rows that repeat an id or a whole document each get a place of their own; which of equal
rows gets which place does not matter. An empty table gives no rows, and fewer documents than shards leave
shards empty, as does a document larger than a target. Columns other than id and text are ignored by
``assign`` and kept by ``write``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import text_key
from vitrine.session import materialize, run_dir

#: ``monotonically_increasing_id`` holds the partition above this bit and the place in it below.
PLACE_BITS = 33


def doc_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _ordered(rows: DataFrame, partition_rows: int) -> DataFrame:
    """``rows`` (with ``_id``, ``_tk``, ``_n``) in range partitions, written, with their place ``_rid``.

    Equal rows are spread by their place in the input, so that many copies fill no partition.
    """
    rows = materialize(rows, "shard-rows")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, math.ceil(rows.count() / partition_rows))
    key = [F.col("_id").asc_nulls_first(), F.col("_tk").asc(), F.col("_at").asc()]
    ranged = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, *key)
    ranged = ranged.sortWithinPartitions(*key).drop("_at").withColumn("_rid", F.monotonically_increasing_id())
    return materialize(ranged, "shard-order")


def _starts(ordered: DataFrame, shards: int) -> DataFrame:
    """``(_part, _before, _starts)`` per partition: rows before it, and the first row of each shard in it.

    ``_starts`` is sorted and holds (rid, shard, number of the shard's first row). The table has one row a
    partition and at most one entry more a shard.
    """
    part, place = F.shiftright("_rid", PLACE_BITS), F.col("_rid").bitwiseAND((1 << PLACE_BITS) - 1)
    totals = ordered.groupBy(part.alias("_part")).agg(F.sum("_n").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = totals.select(
        "_part",
        "bytes",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("total"),
    )
    # Twice the middle of a row's bytes is a whole number; the product may pass a long.
    totals = totals.withColumns(
        {
            "low": _target(F.col("bytes_before") * 2, shards),
            "high": _target((F.col("bytes_before") + F.col("bytes")) * 2 - 1, shards),
        }
    )
    totals = materialize(totals, "shard-totals")
    whole = totals.where("low = high").select(
        "_part", F.shiftleft("_part", PLACE_BITS).alias("_rid"), F.col("low").alias("shard"), "rows_before"
    )
    cut = F.broadcast(totals.where("low < high"))
    upto = Window.partitionBy("_part").orderBy("_rid").rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        ordered.select("_rid", "_n", part.alias("_part"))
        .join(cut, "_part")
        .withColumn("_middle", (F.col("bytes_before") + F.sum("_n").over(upto)) * 2 - F.col("_n"))
        .withColumn("shard", _target(F.col("_middle"), shards))
        .groupBy("_part", "shard")
        .agg(F.min("_rid").alias("_rid"), F.first("rows_before").alias("rows_before"))
    )
    starts = materialize(whole.unionByName(inside), "shard-starts")
    first = starts.groupBy("shard").agg(F.min(F.col("rows_before") + place).alias("first"))
    return (
        starts.join(F.broadcast(first), "shard")
        .groupBy("_part")
        .agg(
            F.first("rows_before").alias("_before"),
            F.array_sort(F.collect_list(F.struct("_rid", F.col("shard").cast("int").alias("shard"), "first"))).alias("_starts"),
        )
    )


def _target(twice_bytes: Column, shards: int) -> Column:
    """The shard in which half of ``twice_bytes`` lies, of the ``total``."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(twice_bytes) * shards, wide(F.col("total") * 2))


def _placed(ordered: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to the ordered rows."""
    starts = materialize(_starts(ordered, shards), "shard-cuts")
    rid, place = F.col("_rid"), F.col("_rid").bitwiseAND((1 << PLACE_BITS) - 1)
    # One row a partition and one entry a shard, whatever the rows are: small by construction.
    joined = ordered.withColumn("_part", F.shiftright("_rid", PLACE_BITS)).join(F.broadcast(starts), "_part")
    joined = joined.withColumn("_in", F.element_at(F.filter("_starts", lambda x: x["_rid"] <= rid), -1))
    return joined.withColumns(
        {"shard": F.col("_in.shard"), "slot": F.col("_before") + place - F.col("_in.first")}
    ).drop("_part", "_before", "_starts", "_in")


def assign(docs: DataFrame, shards: int = 8, partition_rows: int = 1_000_000) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` per row of ``docs``; the texts are read once and not moved."""
    text = docs["text"]
    rows = docs.select(
        docs["doc_id"].cast("long").alias("_id"),
        F.coalesce(text_key(text), F.lit(0)).alias("_tk"),
        doc_size(text).alias("_n"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"),
    )
    return _placed(_ordered(rows, partition_rows), shards).select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot"
    )


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def write(docs: DataFrame, path: str | None = None, shards: int = 8, partition_rows: int = 1_000_000) -> str:
    """Write ``docs`` as Parquet below ``path``, one folder ``shard=i`` a shard, with all its columns and ``slot``.

    Where the table has columns of these names, the new ones end in underscores. The rows move once, into their
    order; the shards are then read off their places.
    """
    path = path or run_dir(docs.sparkSession, "shards")
    # The columns travel in one struct, so that no name of theirs can clash.
    text = docs["text"]
    rows = docs.select(
        docs["doc_id"].cast("long").alias("_id"),
        F.coalesce(text_key(text), F.lit(0)).alias("_tk"),
        doc_size(text).alias("_n"),
        F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("_row"),
    )
    slot, shard = _free("slot", docs.columns), _free("shard", docs.columns)
    placed = _placed(_ordered(rows, partition_rows), shards)
    out = placed.select("_row.*", F.col("slot").alias(slot), F.col("shard").alias(shard))
    out.write.partitionBy(shard).parquet(path)
    return path
