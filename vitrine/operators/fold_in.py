"""Vectors of customers that a factor model has not seen, from its item factors.

For implicit feedback a customer's vector is the solution of the customer's own normal equations: the Gram matrix of all items, which
all customers share, plus the confidence-weighted outer products of the few items the customer bought, plus the
regularisation by their number. It is what the fit itself computes for its customers in its last step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import materialize

VECTORS = "customer_id string, vec array<double>"
#: Rows whose outer products are held at once; a customer with more is summed by a product of their own.
ROWS_AT_ONCE = 1 << 14


def _matrix(column: pa.ChunkedArray | pa.Array, rank: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, rank)


def gram(items: DataFrame, rank: int) -> np.ndarray:
    """Sum of the outer products of all item vectors; ``rank`` squared numbers leave each task."""

    def part(batches):
        total = np.zeros((rank, rank))
        for batch in batches:
            rows = _matrix(batch.column(0), rank)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    vectors = items.where("vec is not null").select(F.col("vec").cast("array<double>"))
    parts = vectors.mapInArrow(part, "g array<double>").collect()
    return sum((np.array(r["g"]).reshape(rank, rank) for r in parts), np.zeros((rank, rank)))


def _solved(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solutions of many small systems; of least length where one has no single solution."""
    try:
        return np.linalg.solve(left, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.array([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(left, right)])


def _normal_equations(y: np.ndarray, w: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per run of rows between ``edges`` the weighted sums of the outer products and of the rows."""
    rank = y.shape[1]
    left, right = np.empty((len(edges) - 1, rank, rank)), np.empty((len(edges) - 1, rank))
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + ROWS_AT_ONCE, "right")) - 1)
        s, e = edges[at], edges[to]
        if to == at + 1:
            left[at], right[at] = (y[s:e].T * w[s:e]) @ y[s:e], (1 + w[s:e]) @ y[s:e]
        else:
            starts = edges[at:to] - s
            left[at:to] = np.add.reduceat((w[s:e, None] * y[s:e])[:, :, None] * y[s:e, None, :], starts)
            right[at:to] = np.add.reduceat((1 + w[s:e, None]) * y[s:e], starts)
        at = to
    return left, right


def fold_in(
    purchases: DataFrame, items: DataFrame, rank: int, reg: float = 0.1, alpha: float = 1.0, bucket_rows: int = 200_000
) -> DataFrame:
    """``(customer_id, vec)`` of every customer of ``purchases`` who bought an item that has a vector.

    ``items`` is ``(article_id, vec)`` of the fit; ``reg`` and ``alpha`` are the fit's. As in the fit, purchases without a customer are no customer's. A customer has at most one row
    per article, and customers are solved in buckets of about ``bucket_rows`` of them.
    """
    shared = gram(items, rank)
    # read for their number and to be solved
    counts = materialize(purchases.where("customer_id is not null").groupBy("customer_id", "article_id").agg(F.count("*").alias("n")), "purchase-counts")
    rows = counts.join(items.where("vec is not null").select("article_id", "vec"), "article_id")
    buckets = max(1, math.ceil(counts.count() / bucket_rows))

    def solve(table: pa.Table) -> pa.Table:
        codes = table["customer_id"].combine_chunks().dictionary_encode()
        order = np.argsort(codes.indices.to_numpy(), kind="stable")
        who = codes.indices.to_numpy()[order]
        y = _matrix(table["vec"], rank)[order]
        w = alpha * table["n"].to_numpy()[order].astype(np.float64)
        edges = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1], [True]]))
        left, right = _normal_equations(y, w, edges)
        left += shared + reg * np.diff(edges)[:, None, None] * np.eye(rank)
        out = pa.array(_solved(left, right).ravel())
        ids = codes.dictionary.take(pa.array(who[edges[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * rank, pa.int32()), out)
        return pa.table({"customer_id": ids, "vec": lists})

    bucketed = rows.select(F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).alias("bucket"), F.col("customer_id").cast("string"), "n", "vec")
    return bucketed.groupBy("bucket").applyInArrow(solve, VECTORS)
