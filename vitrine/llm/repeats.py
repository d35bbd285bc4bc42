"""Exact substring dedup: repeated passages found by automata.

A window is ``width`` consecutive words of a document. A word goes if a window that covers it also
starts in a document with a smaller id. Windows are judged on the input.

1. Every window has a seed: the smallest hash of the five-word runs in it. Seeds that stand in two
   documents are the recurring ones; a window whose seed is not recurring stands in one document.
2. Consecutive windows with the same recurring seed form a region. Equal regions become one row with
   the smallest id.
3. Regions are dealt to shards by seed. In a shard the windows that recur are confirmed word by word
   and compiled into an Aho-Corasick automaton over words, and all its regions stream through it to locate every
   occurrence. A seed with too many different regions is first cut into single windows, which are
   dealt by their own words, so that one passage never fills a task.
4. Occurrences go back to their documents as word ranges.

Documents with the same text are one document with the smallest id in steps 1 to 3; all words of the
others go, if they have a window. Words are runs of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return. Null texts have no words. Rows with a null id have no smaller id and are
nobody's smaller id: they keep all words. Rows that repeat an id do not count as smaller than each other; each text has
its own marks.
Empty tables give no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import U64, gram_hashes, small, text_key, word_hashes
from vitrine.session import materialize

RUN = 5


def window_seeds(words: list[bytes], width: int, run: int = RUN) -> np.ndarray:
    """The seed of the window that starts at each word."""
    g = gram_hashes(word_hashes(words), run)
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = g[:n].copy()
    for i in range(1, width - run + 1):
        np.minimum(out, g[i : i + n], out=out)
    return out.view(np.int64)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, fp, n, seeds, tk)`` per row: print of the words, their number, distinct seeds, key of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                prints, counts, seeds = [], [], []
                for text in some.column(1).to_pylist():
                    words = (text or b"").split()
                    prints.append(xxhash.xxh128_digest(b" ".join(words)))
                    counts.append(len(words))
                    seeds.append(np.unique(window_seeds(words, width)))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), pa.array(seeds, pa.list_(pa.int64())), some.column(2)],
                    names=["doc_id", "fp", "n", "seeds", "tk"],
                )

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), text_key(F.col("text").cast("binary")).alias("tk"))
    return cols.mapInArrow(run, "doc_id long, fp binary, n long, seeds array<long>, tk long")


def _regions(width: int):
    """Texts with their recurring seeds to regions: ``(seed, doc_id, at, windows, words, tk)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                rows: list[tuple] = []
                for doc, text, seeds, tk in zip(*(some.column(i).to_pylist() for i in range(4))):
                    words = (text or b"").split()
                    s = window_seeds(words, width)
                    if not len(s):
                        continue
                    edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                    ends = np.append(edges[1:], len(s))
                    wanted = np.isin(s[edges], np.array(seeds, np.int64))
                    for a, z in zip(edges[wanted].tolist(), ends[wanted].tolist()):
                        rows.append((int(s[a]), doc, a, z - a, b" ".join(words[a : z + width - 1]), tk))
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["seed", "doc_id", "at", "windows", "words", "tk"]
                )

    return run


def _cut(width: int):
    """Regions to single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                rows = []
                for seed, doc, at, n, text, tk in zip(*(some.column(i).to_pylist() for i in range(6))):
                    words = text.split()
                    rows += [(seed, doc, at + i, 1, b" ".join(words[i : i + width]), tk) for i in range(n)]
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], schema=batch.schema)

    return run


def _locate(width: int):
    """One shard of distinct regions: ``(key, print, off, first)`` of every window that recurs."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}  # words of this shard
        regions = [tuple([number.setdefault(w, len(number)) for w in t.split(b" ")]) for t in shard["words"]]
        first: dict[tuple, int] = {}
        again: set[tuple] = set()
        for words, low, high in zip(regions, shard["first"].tolist(), shard["last"].tolist()):
            for i in range(len(words) - width + 1):
                phrase = words[i : i + width]
                seen = first.setdefault(phrase, low)
                if seen != low or high != low:
                    again.add(phrase)
                    if low < seen:
                        first[phrase] = low
        out: list[tuple] = []
        if again:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            lows = []
            for phrase in again:
                automaton.add_word(phrase, len(lows))
                lows.append(first[phrase])
            automaton.make_automaton()
            for i, words in enumerate(regions):
                out += [(i, end - width + 1, lows[k]) for end, k in automaton.iter(words)]
        at = [r[0] for r in out]
        return pd.DataFrame(
            {
                "seed": shard["seed"].to_numpy()[at],
                "print": shard["print"].to_numpy()[at],
                "off": np.array([r[1] for r in out], np.int64),
                "low": np.array([r[2] for r in out], np.int64),
            }
        )

    return run


def occurrences(docs: DataFrame, width: int = 13, shard_regions: int = 20_000, hot: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, tk, starts)``: the windows of each text that start in a smaller id too; and ``(doc_id, tk, rep)``."""
    prof = materialize(profiles(docs, width), "repeat-profiles")
    same = prof.where("doc_id is not null and n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    same = materialize(same, "repeat-prints")
    reps = prof.where(F.size("seeds") > 0).join(
        same, (prof["fp"] == same["fp"]) & (prof["doc_id"] == same["rep"]), "left_semi"
    )
    seeds = reps.select("doc_id", F.explode("seeds").alias("seed"))
    recurring = seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    wanted = (
        seeds.join(recurring.select("seed"), "seed", "left_semi").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    texts = texts.withColumn("tk", text_key("text"))
    kinds = "seed long, doc_id long, at long, windows long, words binary, tk long"
    wanted = materialize(wanted, "repeat-wanted")
    texts = texts.join(small(materialize(wanted.select("doc_id"), "repeat-ids")), "doc_id", "left_semi")
    regions = texts.join(wanted, "doc_id").select("doc_id", "text", "seeds", "tk").mapInArrow(_regions(width), kinds)
    regions = materialize(regions.withColumn("print", F.xxhash64("words")), "regions")

    # Distinct regions of a seed; many of one seed are cut into windows.
    distinct = lambda df: df.groupBy("seed", "print", "words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    kinds_of = regions.select("seed", "print").distinct().groupBy("seed").count()
    crowded = materialize(kinds_of.where(F.col("count") > hot).select("seed"), "hot-seeds")
    # Regions that stand alone under their seed cannot recur; they need no shard.
    calm = regions.join(crowded, "seed", "left_anti")
    single = regions.join(crowded, "seed", "left_semi").select("seed", "doc_id", "at", "windows", "words", "tk")
    single = single.mapInArrow(_cut(width), kinds).withColumn("print", F.xxhash64("words"))
    single = materialize(single, "hot-windows")
    calm_rows, hot_rows = distinct(calm), distinct(single)
    n = max(1, math.ceil(regions.count() / shard_regions))
    m = max(1, math.ceil(single.count() / shard_regions))
    found_kinds = "seed long, print long, off long, low long"

    def located(rows: DataFrame, key: list[str], shards: int) -> DataFrame:
        rows = rows.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards)))
        return rows.groupBy("shard").applyInPandas(_locate(width), found_kinds)

    out = None
    for source, rows, key, shards in ((calm, calm_rows, ["seed"], n), (single, hot_rows, ["seed", "words"], m)):
        hits = located(rows, key, shards)
        part = (
            source.select("seed", "print", "doc_id", "at", "tk")
            .join(hits, ["seed", "print"])
            .where("low < doc_id")
            .select("doc_id", "tk", (F.col("at") + F.col("off")).alias("start"))
        )
        out = part if out is None else out.unionByName(part)
    starts = out.groupBy("doc_id", "tk").agg(F.collect_set("start").alias("starts"))
    return starts, prof.select("doc_id", "fp", "tk").join(same, "fp", "left").select("doc_id", "tk", "rep")


def dedup(docs: DataFrame, width: int = 13, **params) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row; ``kept`` is the words left, joined by one space."""
    starts, prints = occurrences(docs, width, **params)
    starts = materialize(starts, "repeat-starts")
    copies = prints.where("rep < doc_id").select("doc_id", "tk").distinct().withColumn("copy", F.lit(True))
    marks = starts.join(copies, ["doc_id", "tk"], "full_outer")
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "starts", "copy")
    marks = materialize(marks, "repeat-marks")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    # Documents without a mark need no join with the marks.
    marked = small(materialize(marks.select("_id"), "repeat-marked"))
    same = F.col("doc_id") == F.col("_id")
    plain = rows.join(marked, same, "left_anti").withColumns({"starts": F.lit(None).cast("array<long>"), "copy": F.lit(None).cast("boolean")})
    # An id may repeat with another text, which has marks of its own or none.
    hit = rows.join(marked, same, "left_semi").join(marks, same & (text_key("text") == F.col("_tk")), "left")
    rows = plain.unionByName(hit.select("doc_id", "text", "starts", "copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                counts, removed, kept = [], [], []
                for text, at, copy in zip(*(some.column(i).to_pylist() for i in (1, 2, 3))):
                    words = (text or b"").split()
                    if copy and len(words) >= width:
                        left = []
                    elif at:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, np.array(at), 1)
                        np.add.at(edge, np.array(at) + width, -1)
                        left = [w for w, c in zip(words, np.cumsum(edge).tolist()) if not c]
                    else:
                        left = words
                    counts.append(len(words))
                    removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
