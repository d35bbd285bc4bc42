"""Hard negatives by Fagin's threshold algorithm over sorted lists of every dimension.

The vectors are dealt to shards. A shard keeps one list of its rows for each dimension, sorted by that component.
An anchor reads all lists in step, from the end its own component's sign asks for (sorted access); each
row it meets for the first time is scored whole by the integer inner product (random access). The
threshold is the score of a row that would hold the components read last: no row that was not met yet
scores more. Reading stops when the threshold is strictly below the k-th score found in each window, or below
the window itself, so equal scores beyond the k-th are met too.

1. The positives of an anchor are its first ``positives`` rows of the same label: one window without limits,
   over the shards of the label's bucket.
2. Each positive gives a window of scores, ``low`` to ``high`` percent of the positive's score, over
   all shards; the first ``negatives`` rows of another label in it are the hard negatives.

Higher scores come first, then smaller ids. Rows with a null id or label, a null vector, or a null or
non-finite component take no part. Vectors of different lengths do not meet. Of rows that repeat an id only the one
with the smallest label, then vector takes part. A label may hold any share of the rows: its bucket is cut into
blocks. An empty table, an anchor without another row of its label, and a positive score of less than zero (its window
is empty) give no rows. Other columns are ignored. Scores beyond a long are held at its limits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import small
from vitrine.session import materialize

LONG_MAX = 2**63 - 1
POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def labelled_vectors(df: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """``(vec_id, label, vec)``: components as ``floor(scale * x)``, rows that take no part left out."""
    vec = df["embedding"]
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == math.inf))
    return df.where(df["vec_id"].isNotNull() & label.isNotNull() & vec.isNotNull() & ~bad).select(
        df["vec_id"].cast("long").alias("vec_id"),
        label.alias("label"),
        F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vec"),
    )


class SortedLists:
    """One list a dimension over the rows of a shard."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.points, self.ids, self.by_id = points[by_id], ids[by_id], by_id
        self.order = np.argsort(self.points, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.points, self.order.astype(np.int64), axis=0)

    def search(self, q: np.ndarray, fit: np.ndarray, windows: list[tuple], k: int) -> list[list[tuple]]:
        """The first ``k`` ``(score, id)`` of each window ``(low, high)`` among rows that ``fit``; None is no limit."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        scores = np.zeros(n, self.points.dtype)
        depth, step = 0, 4
        open_windows = list(range(len(windows)))
        while depth < n and open_windows:
            # What a row not met yet can score at most: the next component of every list.
            threshold = int(self.sorted[n - 1 - depth, up] @ q[up]) + int(self.sorted[depth, down] @ q[down])
            open_windows = [i for i in open_windows if not self._closed(threshold, windows[i], scores, seen & fit, k)]
            if not open_windows:
                break
            stop = min(n, depth + step) if len(up) + len(down) else n
            met = np.zeros(n, bool)
            met[self.order[n - stop : n - depth, up].ravel()] = True
            met[self.order[depth:stop, down].ravel()] = True
            if stop == n:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            scores[new] = self.points[new] @ q
            seen[new] = True
            depth, step = stop, step * 2
        self.read = depth  # how far down the lists the last search went
        ready = seen & fit
        return [self._best(scores, ready, w, k) for w in windows]

    @staticmethod
    def _inside(scores: np.ndarray, ready: np.ndarray, window: tuple) -> np.ndarray:
        low, high = window
        if low is not None:
            ready = ready & np.asarray(scores >= low, bool)
        if high is not None:
            ready = ready & np.asarray(scores <= high, bool)
        return np.flatnonzero(ready)

    def _closed(self, threshold: int, window: tuple, scores: np.ndarray, ready: np.ndarray, k: int) -> bool:
        low, high = window
        if low is not None and (threshold < low or (high is not None and high < low)):
            return True
        found = scores[self._inside(scores, ready, window)]
        return len(found) >= k and threshold < int(np.sort(found)[-k])

    def _best(self, scores: np.ndarray, ready: np.ndarray, window: tuple, k: int) -> list[tuple]:
        at = self._inside(scores, ready, window)
        # Rows are in order of ids, so a stable sort leaves the smaller id first among equals.
        at = at[np.argsort(-scores[at], kind="stable")][:k]
        return [(int(scores[i]), int(self.ids[i])) for i in at]


def _rows(vecs: pd.Series) -> np.ndarray:
    return np.array(vecs.tolist(), dtype=np.int64).reshape(len(vecs), -1)


def _exact(points: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as whole numbers that cannot overflow in a product."""
    peak = lambda a: max(1, abs(int(a.min(initial=0))), abs(int(a.max(initial=0))))
    if peak(points) * peak(asked) * max(1, points.shape[1]) >= 2**62:
        return points.astype(object), asked.astype(object)
    return points, asked


def _held(score: int) -> int:
    return max(-LONG_MAX - 1, min(LONG_MAX, score))


def _frame(out: list[tuple], kinds: str) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")]).astype("int64")


def _positive_finder(k: int):
    def run(points: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(points) and len(anchors):
            p, q = _exact(_rows(points["vec"]), _rows(anchors["vec"]))
            lists = SortedLists(p, points["vec_id"].to_numpy())
            labels = points["label"].to_numpy()[lists.by_id]
            for own, label, vec in zip(anchors["vec_id"], anchors["label"], q):
                fit = (labels == label) & (lists.ids != own)
                found = lists.search(vec, fit, [(None, None)], k)[0]
                out += [(own, i, _held(s)) for s, i in found]
        return _frame(out, POSITIVES)

    return run


def _negative_finder(k: int, low: int, high: int):
    def run(points: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(points) and len(anchors):
            p, q = _exact(_rows(points["vec"]), _rows(anchors["vec"]))
            lists = SortedLists(p, points["vec_id"].to_numpy())
            labels = points["label"].to_numpy()[lists.by_id]
            for own, label, pairs, vec in zip(anchors["vec_id"], anchors["label"], anchors["pairs"], q):
                pairs = [(int(x["positive_id"]), int(x["positive_score"])) for x in pairs]
                windows = [(-(-low * s // 100), high * s // 100) for _, s in pairs]
                found = lists.search(vec, labels != label, windows, k)
                for (pos, s), best in zip(pairs, found):
                    out += [(own, pos, s, i, _held(t)) for t, i in best]
        return _frame(out, NEGATIVES)

    return run


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    shard_rows: int = 4096,
    most_shards: int = 256,
    most_rows: int = 65_536,
    anchor_rows: int = 4096,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` is ``(vec_id, label, vec)`` of whole numbers, as ``labelled_vectors`` gives them; ``anchors`` tells which
    rows of it ask. Shards hold ``shard_rows`` rows, more where there would be over ``most_shards`` of them, but
    never more than about ``most_rows``; anchors come in blocks of about ``anchor_rows``.
    """
    one = vectors.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x"))
    one = materialize(one.select("vec_id", "x.label", "x.vec", F.size("x.vec").alias("dim")), "labelled-vectors")
    asked = materialize(one.where(anchors), "anchors")
    rows = one.count()
    width = max(shard_rows, min(most_rows, math.ceil(rows / most_shards)))
    shards = max(1, math.ceil(rows / width))
    blocks = max(1, math.ceil(asked.count() / anchor_rows))
    spread = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), n).cast("int")

    # Positives: rows of a label share a bucket, large buckets are cut into cells.
    bucketed = lambda df: df.withColumn("bucket", spread(F.col("label"), F.lit(shards), 1))
    sizes = bucketed(one).groupBy("bucket").agg(F.ceil(F.count("*") / width).cast("int").alias("cells"))
    sizes = materialize(sizes, "label-buckets")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    cell = ["dim", "bucket", "cell", "block"]
    turns = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    theirs = bucketed(one).join(small(sizes), "bucket").withColumn("cell", spread(F.col("vec_id"), F.col("cells"), 2)).withColumn("block", turns)
    asking = bucketed(asked).join(small(sizes.select(F.col("bucket").alias("bucket"), F.col("cells").alias("cells"))), "bucket").withColumn("cell", every)
    asking = asking.withColumn("block", spread(F.col("vec_id"), F.lit(blocks), 3))
    near = theirs.groupBy(*cell).cogroup(asking.groupBy(*cell)).applyInPandas(_positive_finder(positives), POSITIVES)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pairs = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("pairs"))

    # Negatives: all shards, one window a positive.
    windows = asked.join(materialize(pairs, "positives"), F.col("vec_id") == F.col("anchor_id"))
    windows = windows.withColumns(
        {
            "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))),
            "block": spread(F.col("vec_id"), F.lit(blocks), 3),
        }
    )
    points = one.withColumn("shard", spread(F.col("vec_id"), F.lit(shards), 2)).withColumn("block", turns)
    group = ["dim", "shard", "block"]
    found = points.groupBy(*group).cogroup(windows.groupBy(*group)).applyInPandas(_negative_finder(negatives, low, high), NEGATIVES)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
