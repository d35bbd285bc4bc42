"""Exact top-k inner-product search: a ball tree per shard, branch and bound, shared bounds.

Each shard is one task group: it builds a ball tree over its vectors and searches its queries best
node first, by the upper bound ``q.centre + |q| * radius``. First every query searches the shard
of its own hash; its k-th score there is sent with it to all other shards, where nodes and
vectors below that score are cut. Queries come in blocks, so neither side is ever whole in a task.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without
id. Vectors of different lengths do not meet. Equal scores go to the smaller id. Rows that repeat
an id are the same vector's row and are skipped by the query of that id; other columns are
ignored. An empty table gives no rows. Scores beyond a long are held at its limits.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import materialize

HITS = "query_id long, vec_id long, score long"
LONG_MAX = 2**63 - 1


def quantize(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """``(vec_id, vec)``: components as ``floor(scale * x)``, rows that take no part left out."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == math.inf))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vec"),
    )


class BallTree:
    """Nodes over rows kept in node order; ``ids`` ascend inside equal vectors."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 64):
        self.points, self.ids = points, ids
        as_float = points.astype(np.float64)
        order = np.arange(len(ids))
        self.lo, self.hi, self.kids, centres, radii = [], [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            rows = as_float[order[lo:hi]]
            centre = rows.mean(axis=0)
            far = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([])
            centres.append(centre)
            radii.append(far.max())
            if parent >= 0:
                self.kids[parent].append(node)
            if hi - lo > leaf and far.max() > 0:
                a = rows[far.argmax()]
                b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
                half = (hi - lo) // 2
                cut = np.argpartition(rows @ (b - a), half)
                order[lo:hi] = order[lo:hi][cut]
                todo += [(lo, lo + half, node), (lo + half, hi, node)]
        self.points, self.ids = points[order], ids[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        q = queries.astype(np.float64)
        size = np.sqrt((q**2).sum(axis=1))[:, None]
        reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii
        return q @ self.centres.T + size * self.radii + 1e-9 * size * reach + 1e-3

    def search(self, q: np.ndarray, bound: np.ndarray, own: int, k: int, floor: int | None):
        """The k best ``(score, id)`` not below ``floor``; nodes by falling bound."""
        best: list[tuple[int, int]] = []  # heap of (score, -id), worst first
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            limit = best[0][0] if len(best) == k else None
            limit = max((x for x in (limit, floor) if x is not None), default=None)
            if limit is not None and -top < limit:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if limit is None or bound[kid] >= limit:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            lo, hi = self.lo[node], self.hi[node]
            scores, ids = self.points[lo:hi] @ q, self.ids[lo:hi]
            fit = ids != own
            if limit is not None:
                fit &= np.asarray(scores >= limit, dtype=bool)
            for i in np.flatnonzero(fit):
                entry = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -i) for s, i in best]


def _rows(vecs: pd.Series) -> np.ndarray:
    return np.array(vecs.tolist(), dtype=np.int64).reshape(len(vecs), -1)


def _distinct(points: np.ndarray, ids: np.ndarray, keep: int):
    """Of equal vectors only the ``keep`` smallest ids can be among anyone's best."""
    order = np.lexsort((ids, *points.T[::-1])) if points.shape[1] else np.argsort(ids)
    points, ids = points[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (points[1:] != points[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return points[rank < keep], ids[rank < keep]


def _searcher(k: int, leaf: int):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(queries):
            p, q = _rows(points["vec"]), _rows(queries["vec"])
            p, ids = _distinct(p, points["vec_id"].to_numpy(), k + 1)
            peak = max(1, abs(int(p.min(initial=0))), abs(int(p.max(initial=0))))
            peak *= max(1, abs(int(q.min(initial=0))), abs(int(q.max(initial=0)))) * max(1, p.shape[1])
            if peak >= 2**62:
                p, q = p.astype(object), q.astype(object)
            tree = BallTree(p, ids, leaf)
            bound = tree.bounds(q)
            for i, (own, floor) in enumerate(zip(queries["vec_id"], queries["floor"])):
                known = None if pd.isna(floor) else int(floor)
                for score, vec in tree.search(q[i], bound[i], own, k, known):
                    out.append((own, vec, max(-LONG_MAX - 1, min(LONG_MAX, score))))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 4096, query_rows: int = 1024, leaf: int = 64
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best other vectors of each query.

    Both frames are ``(vec_id, vec)`` of whole numbers, as ``quantize`` gives them.
    """
    vectors = materialize(vectors, "vectors")
    queries = materialize(queries, "vector-queries")
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / query_rows))
    key = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    points = vectors.withColumns({"dim": F.size("vec"), "shard": key(shards, 1)})
    asked = queries.dropDuplicates(["vec_id"]).withColumns(
        {"dim": F.size("vec"), "home": key(shards, 1), "block": key(blocks, 2)}
    )
    search = _searcher(k, leaf)

    near = (
        points.groupBy("dim", "shard")
        .cogroup(
            asked.withColumns({"shard": F.col("home"), "floor": F.lit(None).cast("long")}).groupBy("dim", "shard")
        )
        .applyInPandas(search, HITS)
    )
    near = materialize(near, "home-hits")
    floors = near.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).alias("floor"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    away = asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    rest = (
        points.withColumn("block", every)
        .groupBy("dim", "shard", "block")
        .cogroup(away.where("shard <> home").groupBy("dim", "shard", "block"))
        .applyInPandas(search, HITS)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.unionByName(rest)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
