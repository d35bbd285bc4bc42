"""Periodic runs of words, found by online dyadic square catching.

Words are appended; whenever ``2**k`` of them from a multiple of ``2**k`` on are complete, a catcher for
that block begins to watch. The catchers of level k hold periods from ``2**(k+1)`` up to ``2**(k+2)``: every square of
such a period has a whole block in its first half, and its second half repeats the block one period later. So each
appended word completes one window of ``2**k`` words a level, which is compared with the two blocks
whose catchers are due at that distance. A window that agrees is a catch (block, period). Catches of
neighbouring blocks with the same period merge into one stretch; comparing words before and after it gives the run.
Windows are compared by hashes of hashes of their halves; every run is then compared word by word.

A run is a longest stretch of consecutive words with smallest period q and at least
``max(least, exponent * q)`` words. Multiples of a period lie within the run of that period and are no
runs of their own. A collapsed text keeps the words that no run contains after its first period.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. A null
or empty text has no words and no runs. Each row is judged by itself, so null ids, repeated ids and repeated
rows are rows like any other. An empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import U64, mix

RUN = "struct<start:bigint,length:bigint,period:bigint>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
#: Words that are looked through at once; a longer document makes a slab of its own.
SLAB = 1 << 18
#: Bytes of text that one slab may gather before its words are known.
SLAB_BYTES = 1 << 22


class Catchers:
    """Catchers over a growing row of word numbers, for runs of at least ``exponent`` periods and ``least`` words."""

    def __init__(self, exponent: int = 2, least: int = 2):
        if exponent < 2:
            raise ValueError("a run holds at least a square: exponent >= 2")
        self.exponent, self.least = exponent, least
        self.words = np.empty(0, np.int64)
        self.windows: list[np.ndarray] = []  # by level: hash of the 2**k words from each place on
        self.caught: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by level: first word of the block, period
        self.ones: list[np.ndarray] = []  # words equal to the next one: period 1

    def need(self, period: int) -> int:
        return max(self.least, self.exponent * period)

    def append(self, words: np.ndarray, reach: Callable[[int], int] | None = None) -> None:
        """Append word numbers, one or many; what is caught does not depend on how they are dealt out.

        ``reach(n)`` tells how many of the leading words can lie in a run of at least n words, for
        rows made of several documents; the default is all of them.
        """
        old, self.words = len(self.words), np.concatenate([self.words, np.asarray(words, np.int64)])
        w = self.words
        low = max(0, old - 1)
        self.ones.append(low + np.flatnonzero(w[low:-1] == w[low + 1 :]))
        level = 0
        while True:
            size = 1 << level
            n = min(len(w), reach(self.need(2 * size))) if reach else len(w)
            if n < self.need(2 * size):
                break
            if level == len(self.windows):
                self.windows.append(np.empty(0, U64))
                self.caught.append([])
            done = len(self.windows[level])
            ready = n - size + 1
            if ready > done:
                self.windows[level] = np.concatenate([self.windows[level], self._hashes(level, done, ready)])
                self._catch(level, done, ready)
            level += 1

    def _hashes(self, level: int, low: int, high: int) -> np.ndarray:
        """Hashes of the windows of a level that begin at ``low`` up to ``high``."""
        if level == 0:
            return mix(self.words[low:high].view(U64) + U64(0x9E3779B97F4A7C15))
        half, below = 1 << (level - 1), self.windows[level - 1]
        return mix(below[low:high] * U64(0xD1342543DE82EF95) + below[low + half : high + half] + U64(level))

    def _catch(self, level: int, low: int, high: int) -> None:
        """Compare the new windows with the blocks two and three before their own."""
        size, h = 1 << level, self.windows[level]
        blocks = h[::size]
        for back in (2, 3):
            first = max(low, back * size)
            if first >= high:
                continue
            at = np.arange(first, high)
            block = (at >> level) - back
            hit = np.flatnonzero(h[first:high] == blocks[block])
            if len(hit):
                begin = block[hit] << level
                self.caught[level].append((begin, at[hit] - begin))

    def runs(self) -> np.ndarray:
        """``(start, end, period)`` of the runs so far, by start, then period."""
        found = np.empty((0, 3), np.int64)
        ones = np.concatenate(self.ones) if self.ones else np.empty(0, np.int64)
        levels = [(1, ones, np.ones(len(ones), np.int64))]
        for level, caught in enumerate(self.caught):
            if caught:
                levels.append((1 << level, *(np.concatenate(c) for c in zip(*caught))))
        for size, begin, period in levels:
            if not len(begin):
                continue
            found = np.concatenate([found, self._merge(size, begin, period, found)])
        return found[np.lexsort((found[:, 2], found[:, 0]))]

    def _merge(self, size: int, begin: np.ndarray, period: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Catches of neighbouring blocks become stretches; those that are long enough become runs."""
        order = np.lexsort((begin, period))
        begin, period = begin[order], period[order]
        new = np.ones(len(begin), bool)
        new[1:] = (period[1:] != period[:-1]) | (begin[1:] != begin[:-1] + size)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(begin)) - 1
        low, high, p = begin[first], begin[last] + size, period[first]
        # The stretch goes on for less than a block on either side.
        long = high - low + 2 * (size - 1) + p >= np.maximum(self.least, self.exponent * p)
        low, high, p = low[long], high[long], p[long]
        if len(found) and len(low):
            # What lies in a run of a smaller period repeats a multiple of it.
            by = np.argsort(found[:, 0], kind="stable")
            at = np.searchsorted(found[by, 0], low, side="right") - 1
            end = np.maximum.accumulate(found[by, 1])
            fresh = (at < 0) | (end[np.maximum(at, 0)] < high + p)
            low, high, p = low[fresh], high[fresh], p[fresh]
        out = []
        w = self.words
        for a, z, q in zip(low.tolist(), high.tolist(), p.tolist()):
            a, z = max(0, a - size + 1), min(len(w) - q, z + size - 1)
            same = np.concatenate([[False], w[a:z] == w[a + q : z + q], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if e - s + q >= self.need(q):
                    out.append((a + s, a + e + q, q))
        return np.unique(np.array(out, np.int64).reshape(-1, 3), axis=0)


def _slab(texts: list[list[bytes]], exponent: int, least: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """``(index, runs, collapsed)`` of each list of words; runs count from the document's first word."""
    # The longest documents come first, so that higher levels look at a leading part only.
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    # A mark of its own stands after each document, so that nothing repeats across two of them.
    words: list = []
    for i in order:
        words += texts[i]
        words.append(i)
    number: dict = {}
    ids = np.fromiter(map(number.setdefault, words, range(len(words))), np.int64, len(words))
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1

    def reach(n: int) -> int:
        held = int(np.searchsorted(-lengths, -n, side="right"))
        return int(ends[held - 1]) if held else 0

    catchers = Catchers(exponent, least)
    catchers.append(ids, reach)
    runs = catchers.runs()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    dropped = np.cumsum(edge)[:-1] > 0
    cuts = np.searchsorted(runs[:, 0], np.append(starts, len(words)))
    for k, i in enumerate(order):
        own = runs[cuts[k] : cuts[k + 1]]
        kept = texts[i]
        if len(own):
            gone = dropped[starts[k] : ends[k] - 1].tolist()
            kept = [w for w, out in zip(kept, gone) if not out]
        yield i, np.column_stack([own[:, 0] - starts[k], own[:, 1] - own[:, 0], own[:, 2]]), b" ".join(kept)


def _finder(exponent: int, least: int, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None):
    def found(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        out = sorted(_slab(texts, exponent, least), key=lambda x: x[0])
        counts = np.cumsum([0, *(len(r) for _, r, _ in out)])
        flat = np.concatenate([r for _, r, _ in out])
        kinds = [pa.field(n, pa.int64()) for n in ("start", "length", "period")]
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=kinds)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(counts, pa.int32()), structs),
                pa.array([c for _, _, c in out], pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = used = 0
        for batch in batches:
            for row in range(batch.num_rows):
                doc, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py() or b""
                words = text.split()
                if prepare is not None:
                    words = prepare(doc, words)
                if texts and (held + len(words) > SLAB or used + len(text) > SLAB_BYTES):
                    yield found(ids, texts)
                    ids, texts, held, used = [], [], 0, 0
                ids.append(doc)
                texts.append(words)
                held += len(words) + 1
                used += len(text)
        if texts:
            yield found(ids, texts)

    return run


def find(
    docs: DataFrame,
    exponent: int = 4,
    least: int = 6,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` per row; ``runs`` holds (start, length, period) by start, then period.

    ``prepare`` may change the words of a document before it is looked through.
    """
    cols = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("binary"))
    return cols.mapInArrow(_finder(exponent, least, prepare), FOUND)


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Make about one document in ten periodic from one of its words on, as its id decides; a null id changes none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def strongest(runs: Column) -> Column:
    """The run with the most periods; of equal ones the first by start, then period. Null without runs."""
    none = F.lit(None).cast(RUN)
    # Fractions are compared by cross products, so nothing is rounded.
    more = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.aggregate(runs, none, lambda a, x: F.when(a.isNull() | more(a, x), x).otherwise(a))


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the strongest of them, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", *(x[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
