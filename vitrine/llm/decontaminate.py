"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are words in lower case. Runs of ``shortest`` words that both have are
the seeds that bring a document and an item together. Greedy string tiling then marks the longest
non-overlapping matches, found by running Karp-Rabin hashing with a falling search length, until no
unmarked match of ``shortest`` words is left. An item leaks if its marked words are at least
``coverage`` of it, in whatever order its passages stand in the document.

The benchmark goes to the tasks in shards of at most ``shard_chars`` characters, measured first; a
larger benchmark takes several passes over the documents. Each document is judged by itself.

Null and empty texts never match; items under ``shortest`` words, or without text, are no evidence. Null
and repeated ids and repeated rows are judged row by row. Equal matches go to the earlier place.
Empty tables give no hits; other columns are kept by ``clean`` and ignored by ``hits``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import U64, gram_hashes, mix, trimmed

HITS = (
    "doc_id long, item_id long, item_words long, matched_words long, n_tiles long, coverage double, tiles string"
)
BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _windows(h: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of the windows of ``s`` unmarked words, and where they begin."""
    n = len(h) - s + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[s:] == taken[:n])
    powers = np.empty(len(h) + 1, U64)
    powers[0] = 1
    np.cumprod(np.full(len(h), BASE, U64), out=powers[1:])
    # sum(h[i] * base**i) over a window, moved to a common power
    total = np.concatenate([np.zeros(1, U64), np.cumsum(h * powers[:-1])])
    return (total[at + s] - total[at]) * powers[len(h) - at], at


def tile(a: np.ndarray, b: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word numbers: ``(start in a, start in b, length)``."""
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    ha, hb = mix(a.astype(U64) + U64(1)), mix(b.astype(U64) + U64(1))
    # Window hashes of both sides are moved to the same power, so pad to one length.
    size = max(len(a), len(b))
    pad = lambda h: np.concatenate([h, np.zeros(size - len(h), U64)])
    pa_, pb_ = pad(ha), pad(hb)
    s = max(shortest, min(32, len(a), len(b)))
    while True:
        wa, ia = _windows(pa_, np.concatenate([free_a, np.zeros(size - len(a), bool)]), s)
        wb, ib = _windows(pb_, np.concatenate([free_b, np.zeros(size - len(b), bool)]), s)
        order = np.argsort(wa, kind="stable")
        wa, ia = wa[order], ia[order]
        lo, hi = np.searchsorted(wa, wb, "left"), np.searchsorted(wa, wb, "right")
        found, longest = [], 0
        seen: set[tuple[int, int]] = set()
        for j, x, y in zip(ib[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            for i in ia[x:y].tolist():
                if (i - 1, j - 1) in seen:  # inside a longer match that begins earlier
                    seen.add((i, j))
                    continue
                k, most = 0, min(len(a) - i, len(b) - j)
                while k < most and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k >= s:
                    seen.add((i, j))
                    found.append((-k, j, i))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for k, j, i in sorted(found):
            k = -k
            if free_a[i : i + k].all() and free_b[j : j + k].all():
                free_a[i : i + k] = free_b[j : j + k] = False
                out.append((i, j, k))
            else:
                again = True  # what is left of it may still be a match of s words
        if again:
            continue
        if s > 2 * shortest:
            s //= 2
        elif s > shortest:
            s = shortest
        else:
            return sorted(out, key=lambda t: t[1])


class Benchmark:
    """One shard of the benchmark: vocabulary, items as word numbers, seeds."""

    def __init__(self, rows: list[tuple[int, str]], shortest: int):
        self.shortest, self.vocabulary, self.items = shortest, {}, []
        seeds, owners = [], []
        for item, text in rows:
            words = words_of(text)
            if len(words) < shortest:
                continue
            v = self.vocabulary
            nums = np.array([v.setdefault(w, len(v) + 1) for w in words], np.int64)
            grams = np.unique(gram_hashes(mix(nums.astype(U64)), shortest))
            seeds.append(grams)
            owners.append(np.full(len(grams), len(self.items)))
            self.items.append((item, nums))
        self.seeds = np.concatenate([*seeds, np.empty(0, U64)])
        self.owners = np.concatenate([*owners, np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owners = self.seeds[order], self.owners[order]

    def hits(self, text: str | None, coverage: float) -> list[tuple]:
        words = words_of(text)
        if len(words) < self.shortest or not self.items:
            return []
        nums = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        # Only runs of known words can hold a seed.
        unknown = np.concatenate([[0], np.cumsum(nums == 0)])
        at = np.flatnonzero(unknown[self.shortest :] == unknown[: -self.shortest])
        if not len(at):
            return []
        grams = np.unique(gram_hashes(mix(nums.astype(U64)), self.shortest)[at])
        lo, hi = np.searchsorted(self.seeds, grams, "left"), np.searchsorted(self.seeds, grams, "right")
        items = sorted({o for x, y in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()) for o in self.owners[x:y].tolist()})
        out = []
        for o in items:
            item, a = self.items[o]
            tiles = tile(a, nums, self.shortest)
            marked = sum(k for _, _, k in tiles)
            if marked >= coverage * len(a):
                places = ",".join(f"{j}:{i}:{k}" for i, j, k in tiles)
                out.append((item, len(a), marked, len(tiles), marked / len(a), places))
        return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that few texts are held as Python strings at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _shards(benchmark: DataFrame, shortest: int, shard_chars: int) -> list:
    """Broadcasts of the benchmark's shards; each is measured to be small."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("t is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / shard_chars))
    spark = benchmark.sparkSession
    out = []
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        pairs = sorted({(r["i"], r["t"]) for r in part}, key=lambda x: (x[0] is None, x))
        out.append(spark.sparkContext.broadcast(Benchmark(pairs, shortest)))
    return out


def hits(
    docs: DataFrame, benchmark: DataFrame, shortest: int = 5, coverage: float = 0.5, shard_chars: int = 20_000_000
) -> DataFrame:
    """One row per document and leaked item. ``tiles`` is ``word in doc:word in item:length`` of each tile."""
    names = [c.split()[0] for c in HITS.split(", ")]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for shard in _shards(benchmark, shortest, shard_chars):

        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                rows = [
                    (doc, *hit)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for hit in shard.value.hits(text, coverage)
                ]
                cols = zip(*rows) if rows else [[]] * len(names)
                kinds = [pa.int64()] * 5 + [pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

        part = texts.mapInArrow(trimmed(run), HITS)
        out = part if out is None else out.unionByName(part)
    return out


def clean(
    docs: DataFrame, benchmark: DataFrame, shortest: int = 5, coverage: float = 0.5, shard_chars: int = 20_000_000
) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns as they are."""
    at = docs.columns.index("text")
    for shard in _shards(benchmark, shortest, shard_chars):

        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                keep = [not shard.value.hits(text, coverage) for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs
