"""Helpers shared by the text operators: tables, span search in SQL, word hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Matches are located in blocks of this many, so that long lists cost linear time.
BLOCK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A written table of one number a row: marked for broadcast if it is counted to be small.

    Beyond ``most`` rows (16 MB) the join shuffles instead.
    """
    return F.broadcast(ids) if ids.count() <= most else ids


def trimmed(run):
    """A function of Arrow batches that gives freed memory back to the system when its task ends.

    Workers are reused, so what one operator leaves allocated would stand beside the next one's memory.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # a C library without it
                pass

    return wrapped


def text_key(text: Column | str) -> Column:
    """64-bit hash of a text; with the id it names a row where ids repeat or are null."""
    return F.xxhash64(text)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: all matches of a Java pattern, in code points, end exclusive.

    ``split`` gives the text between the matches and ``regexp_extract_all`` the matches; running
    sums of their lengths are the positions. A text without a match gives an empty array.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Both lists are arguments, not looked up inside the lambda, so each is made once a text. There is
    # one gap more than matches; its pair has no match and goes.
    both = F.zip_with(
        F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).cast("long").alias("g"), m.alias("m"))
    )
    pairs = F.filter(both, lambda x: x["m"].isNotNull())
    empty = F.expr("cast(array() as array<struct<s:bigint,e:bigint,m:string>>)")

    def step(acc, x):
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        span = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def located(pairs: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")),
            lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)),
        )
        width = lambda b: F.aggregate(
            b, F.lit(0).cast("long"), lambda a, x: a + x["g"] + F.length(x["m"])
        )
        begins = F.aggregate(
            F.transform(blocks, width),
            F.array(F.lit(0).cast("long")),
            lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)),
        )
        return F.flatten(
            F.transform(
                F.arrays_zip(blocks.alias("b"), begins.alias("o")),
                lambda z: F.when(
                    z["b"].isNotNull(),
                    F.aggregate(
                        z["b"],
                        F.struct(z["o"].alias("at"), empty.alias("out")),
                        step,
                        lambda acc: acc["out"],
                    ),
                ).otherwise(empty),
            )
        )

    # One match list per row: bind it once through a one-element array.
    bound = F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, located(p)).otherwise(empty))
    return F.when(text.rlike(pattern), F.get(bound, F.lit(0))).otherwise(empty)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if seed:
        return np.fromiter((digest(w, seed) for w in words), U64, len(words))
    return np.fromiter(map(digest, words), U64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    mult = 0x9E3779B97F4A7C15
    for i in range(k):
        mult = (mult * 0xD1342543DE82EF95 + 2 * i + 1) % 2**64 | 1
        out += mix(h[i : i + n] + U64(i + 1)) * U64(mult)
    return mix(out)
