"""Threshold retrieval that skips block pairs too far apart to hold a hit.

Items and customers are cut into blocks by space: each vector goes to its nearest pivot, and the vectors of a
pivot into blocks of bounded size. A block is summed up by its centre and the largest angle to it. Two blocks whose centres
are further apart than both angles and the angle of the threshold hold no pair that reaches it; their vectors
are not brought together. What is left is scored exactly, by the kernel of ``scoring``.

How much is skipped depends on the vectors: much where they form groups, little where they point everywhere.
The rows are those of ``retrieval.retrieve_threshold`` in either case.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.retrieval import place, retrieve_threshold, retrieve_topk
from vitrine.operators.scoring import SCALE, TILE, Hits, Rows, bands, split_sides, tiles, unit_rows
from vitrine.session import materialize

#: Angles are widened by this, far beyond what rounding can move them.
SLACK = 1e-6
HITS = "customer_id string, article_id string, score double"


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def pivots_of(items: DataFrame, dim: int, pivots: int) -> np.ndarray:
    """Unit vectors of ``pivots`` items, drawn by a hash of their id."""
    order = F.xxhash64("article_id", F.lit("pivot"))
    drawn = items.where("vec is not null").orderBy(order, "article_id").limit(pivots)
    rows = unit_rows(drawn.select(F.col("vec").cast("array<double>")).toArrow()["vec"], dim)
    return rows[np.linalg.norm(rows, axis=1) > 0]


def _blocks(df: DataFrame, key: str, dim: int, pivots: np.ndarray, most: int) -> DataFrame:
    """``(key, vec, block)``: unit vectors in blocks of about ``most`` rows; rows without direction are left out."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        for batch in batches:
            rows = unit_rows(batch.column(1), dim)
            cell = np.argmax(rows @ shared.value.T, axis=1) if len(rows) else np.empty(0, int)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), dim).cast(pa.list_(pa.float64()))
            batch = pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array(cell, pa.int64())], names=[key, "vec", "cell"])
            yield batch.filter(pa.array(np.linalg.norm(rows, axis=1) > 0))

    rows = df.where("vec is not null").select(F.col(key).cast("string").alias(key), F.col("vec").cast("array<double>"))
    cells = materialize(rows.mapInArrow(nearest, f"{key} string, vec array<double>, cell long"), f"cells-{key}")
    # One number a pivot; a pivot that draws many vectors is cut into more blocks.
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    sizes = F.broadcast(materialize(sizes, f"sizes-{key}"))
    part = F.pmod(F.xxhash64(key), F.col("parts"))
    return cells.join(sizes, "cell").select(key, "vec", (F.col("cell") * (1 << 32) + part).alias("block"))


def _balls(blocks: DataFrame, dim: int) -> DataFrame:
    """``(block, centre, reach)``: unit centre and largest angle to it, of blocks of bounded size."""

    def ball(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(group["vec"].tolist(), float).reshape(-1, dim)
        centre = rows.mean(axis=0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 0 else rows[0]
        reach = _angle(rows @ centre).max() + SLACK
        return pd.DataFrame({"block": [group["block"].iloc[0]], "centre": [centre.tolist()], "reach": [reach]})

    return blocks.select("block", "vec").groupBy("block").applyInPandas(ball, "block long, centre array<double>, reach double")


def block_pairs(users: DataFrame, items: DataFrame, threshold: float, dim: int) -> DataFrame:
    """``(ub, ib)`` of the block pairs that may hold a hit; ``users`` and ``items`` are balls.

    The balls of the items are sent to the tasks: one for some thousand items.
    """
    table = items.toArrow()
    ids = table["block"].to_numpy()
    centres = unit_rows(table["centre"], dim)
    reaches = table["reach"].to_numpy()
    shared = users.sparkSession.sparkContext.broadcast((ids, centres, reaches))
    limit = float(_angle(np.array(threshold))) + SLACK

    def near(batches):
        ids, centres, reaches = shared.value
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            gap = _angle(unit_rows(batch.column(1), dim) @ centres.T)
            u, i = np.nonzero(gap - batch.column(2).to_numpy()[:, None] - reaches <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(u)), pa.array(ids[i])], names=["ub", "ib"])

    return users.select("block", "centre", "reach").mapInArrow(near, "ub long, ib long")


def _dealt(users, items, dim, threshold, pivots, user_block, item_block) -> tuple[DataFrame | None, dict[str, int]]:
    """One band of user blocks a partition: its users, the block pairs that it has to meet, and the items in catalog order."""
    if threshold <= 0:
        raise ValueError("every pair may reach a threshold of 0 or less: nothing can be skipped")
    middle = pivots_of(items, dim, pivots)
    if not len(middle):
        return None, {"pairs": 0, "met": 0}
    u = _blocks(users, "customer_id", dim, middle, user_block)
    i = _blocks(items, "article_id", dim, middle, item_block)
    user_balls, item_balls = materialize(_balls(u, dim), "user-balls"), materialize(_balls(i, dim), "item-balls")
    pairs = materialize(block_pairs(user_balls, item_balls, threshold, dim), "block-pairs")
    share = {"pairs": user_balls.count() * item_balls.count(), "met": pairs.count()}

    # Blocks of users are dealt into bands. A band is held by a task, and an item comes by once in each band that it may
    # have a hit in; neither side is copied once a block of the other.
    n = bands(u.count(), dim, user_block, users.sparkSession.sparkContext.defaultParallelism, 1)
    band = lambda block: F.pmod(F.xxhash64(block), F.lit(n)).cast("int").alias("band")
    none = F.array().cast("array<bigint>").alias("meets")
    left = u.select(band("block"), F.lit(0).alias("side"), F.col("customer_id").alias("id"), "vec", "block", none)
    wanted = pairs.groupBy(band("ub"), F.col("ib").alias("block")).agg(F.collect_list("ub").alias("meets"))
    vec = F.lit(None).cast("array<double>").alias("vec")
    told = wanted.select("band", F.lit(1).alias("side"), F.lit(None).cast("string").alias("id"), vec, "block", "meets")
    right = i.join(wanted.select("band", "block"), "block").select("band", F.lit(2).alias("side"), F.col("article_id").alias("id"), "vec", "block", none)
    dealt = left.unionAll(told).unionAll(right).repartitionById(n, F.col("band"))
    return dealt.sortWithinPartitions("band", "side", "id"), share


class _Band:
    """The user blocks of a band, and which item blocks each has to meet."""

    def __init__(self, batches, dim: int, limit: int):
        held, rest = split_sides(batches)
        own: dict[int, list] = {}
        for batch in held:
            blocks, rows = batch.column(4).to_numpy(), unit_rows(batch.column(3), dim)
            for block in np.unique(blocks):
                at = np.flatnonzero(blocks == block)
                own.setdefault(int(block), []).append((batch.column(2).take(pa.array(at)), rows[at]))
        self.ids, self.hits, self.dim = {}, {}, dim
        for block, parts in own.items():
            self.ids[block] = pa.chunked_array([ids for ids, _ in parts], pa.string()).combine_chunks()
            self.hits[block] = Hits(Rows(np.concatenate([rows for _, rows in parts])), limit)
        told, self.rest = split_sides(rest, 2)
        meets: dict[int, list[int]] = {}
        for batch in told:
            for block, some in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                for ub in some:
                    meets.setdefault(ub, []).append(block)
        self.meets = {ub: np.array(some) for ub, some in meets.items() if ub in self.ids}

    def items(self):
        """``(article ids, unit vectors, {user block: places of the items that it has to meet})`` of some items after the other."""
        for batch in self.rest:
            blocks, at = np.unique(batch.column(4).to_numpy(), return_inverse=True)
            meets = {ub: np.flatnonzero(np.isin(blocks, some)[at]) for ub, some in self.meets.items()}
            yield batch.column(2), Rows(unit_rows(batch.column(3), self.dim)), meets


def _hits(dealt: DataFrame, dim: int, limit: int) -> DataFrame:
    """``(customer_id, article_id, score, place)``: ``place`` counts the hits of a user row from 1 in catalog order."""

    def meet(batches):
        band = _Band(batches, dim, limit)
        for ids, items, meets in band.items():
            for ub, places in meets.items():
                if not len(places):
                    continue
                hits, some = band.hits[ub], items[places]
                found = [hits.tile(raw, some, low) for low, raw in tiles(hits.users, some)]
                rows, cols, scores, order = (np.concatenate(x) for x in zip(*found))
                if len(rows):
                    columns = [band.ids[ub].take(pa.array(rows)), ids.take(pa.array(places[cols])), pa.array(scores / SCALE), pa.array(order)]
                    yield pa.RecordBatch.from_arrays(columns, names=["customer_id", "article_id", "score", "place"])

    return dealt.mapInArrow(meet, f"{HITS}, place long")


def _with_hit(dealt: DataFrame, dim: int, limit: int) -> DataFrame:
    """``(customer_id)`` of the user rows that have a hit; a row is left once its first is found."""

    def meet(batches):
        band = _Band(batches, dim, limit)
        for _, items, meets in band.items():
            for ub, places in meets.items():
                hits = band.hits[ub]
                for low in range(0, len(places) if len(hits.n) else 0, TILE):
                    some = items[places[low : low + TILE]]
                    for at, raw in tiles(hits.users, some):
                        hits.tile(raw, some, at)
                    has = hits.n > 0
                    if has.any():
                        yield pa.RecordBatch.from_arrays([band.ids[ub].filter(pa.array(has))], names=["customer_id"])
                        band.ids[ub], hits.users, hits.n = band.ids[ub].filter(pa.array(~has)), hits.users[~has], hits.n[~has]
                    if not len(hits.n):
                        break

    return dealt.mapInArrow(meet, "customer_id string")


def pruned_hits(
    users: DataFrame,
    items: DataFrame,
    dim: int,
    threshold: float,
    pivots: int = 64,
    user_block: int = 4096,
    item_block: int = 4096,
) -> tuple[DataFrame, dict[str, int]]:
    """``(customer_id, article_id, score)`` of all pairs that reach ``threshold`` (above 0), and how many block
    pairs there are and how many were met."""
    dealt, share = _dealt(users, items, dim, threshold, pivots, user_block, item_block)
    if dealt is None:
        return users.sparkSession.createDataFrame([], HITS), share
    return _hits(dealt, dim, int(np.rint(threshold * SCALE))).drop("place"), share


def retrieve_threshold_pruned(
    users: DataFrame,
    items: DataFrame,
    dim: int,
    threshold: float,
    k: int,
    order: str = "catalog",
    pivots: int = 64,
    user_block: int = 4096,
    item_block: int = 4096,
) -> DataFrame:
    """``retrieval.retrieve_threshold`` by pruned blocks; customers without a hit get their k best.

    Who has a hit is found before, by a pass that stops at the first; the hits themselves are many and are neither kept nor moved.
    """
    if threshold <= 0:
        return retrieve_threshold(users, items, dim, threshold, k, order)
    # read for the blocks and for those without a hit
    users = materialize(users, "users")
    dealt, _ = _dealt(users, items, dim, threshold, pivots, user_block, item_block)
    if dealt is None:
        return retrieve_topk(users, items, dim, k)
    limit = int(np.rint(threshold * SCALE))
    known = materialize(_with_hit(dealt, dim, limit), "with-hit")
    best = retrieve_topk(users.join(known.distinct(), "customer_id", "left_anti"), items, dim, k)
    hits = _hits(dealt, dim, limit)
    ids = users.agg(F.count("*"), F.count_distinct("customer_id")).first()
    if order != "score" and ids[0] == ids[1]:
        # One row a customer: the place its task counted is the rank.
        ranked = hits.withColumn("rank", F.col("place").cast("int"))
    else:
        ranked = place(hits.drop("place"), [F.desc("score"), "article_id"] if order == "score" else ["article_id"])
    return ranked.select(best.columns).unionByName(best)
