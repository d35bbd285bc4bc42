"""Sharding, periodic runs and hard negatives against plain versions."""

import hashlib
import math
import random
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.llm import hard_negatives, periodic, sharding

LONG = " ".join(f"w{i % 997}" for i in range(30_000))


# ---- sharding -----------------------------------------------------------------------


def check_shards(data, out, shards):
    """Every row once, in order of ids, each where the middle of its bytes falls, slots without gaps."""
    size = lambda t: len((t or "").encode()) + 1
    key = lambda d: (d is not None, d or 0)
    want = sorted((key(d), size(t), zlib.crc32((t or "").encode())) for d, t in data)
    assert sorted((key(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    out = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [key(r["doc_id"]) for r in out] == sorted(key(d) for d, _ in data)
    total, before, slots = sum(r["size"] for r in out), 0, {}
    for r in out:
        assert r["shard"] == (2 * before + r["size"]) * shards // (2 * total)
        assert r["slot"] == slots.get(r["shard"], 0)
        slots[r["shard"]] = r["slot"] + 1
        before += r["size"]


DOCS = [(i, f"text {i} é " * (i % 17)) for i in range(300)] + [(7, "x")] * 150 + [(8, f"y{i}") for i in range(40)]
DOCS += [(None, None), (None, "a"), (None, "a"), (-5, ""), (4, LONG)]


@pytest.mark.parametrize("shards,rows", [(8, 1_000_000), (8, 20), (3, 60), (1, 60), (600, 40)])
def test_shards_by_prefix_sums(docs, shards, rows):
    check_shards(DOCS, sharding.assign(docs(DOCS), shards, partition_rows=rows).collect(), shards)


def test_shards_of_little(docs, spark):
    assert sharding.assign(docs([(1, "x")]).where("false")).collect() == []
    few = [(2, "b"), (1, None)]
    check_shards(few, sharding.assign(docs(few)).collect(), 8)
    names = "doc_id long, text string, _id int, _tk string, _n int, _rid int, shard string, slot int, size int, total int"
    odd = spark.createDataFrame([(i, "t" * i, 1, "q", 2, 3, "s", 4, 5, 6) for i in range(50)], names)
    check_shards([(i, "t" * i) for i in range(50)], sharding.assign(odd, 4, partition_rows=10).collect(), 4)


def test_shards_as_files(docs, spark):
    data = docs(DOCS).withColumn("Slot", F.lit("mine"))
    path = sharding.write(data, shards=5, partition_rows=50)
    back = spark.read.parquet(path)
    assert back.columns == [*data.columns, "slot_", "shard"]
    assert sorted(map(str, back.select(*data.columns).collect())) == sorted(map(str, data.collect()))
    out = []
    for r in back.collect():
        text = (r["text"] or "").encode()
        out.append({"doc_id": r["doc_id"], "size": len(text) + 1, "text_crc32": zlib.crc32(text), "shard": r["shard"], "slot": r["slot_"]})
    check_shards(DOCS, out, 5)


def test_shards_stay_in_the_jvm(docs):
    plan = sharding.assign(docs(DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- periodic runs ------------------------------------------------------------------


def caught(words, exponent, least, cuts=()):
    c = periodic.Catchers(exponent, least)
    for a, z in zip([0, *cuts], [*cuts, len(words)]):
        c.append(np.array(words[a:z], np.int64))
    return [(s, e - s, q) for s, e, q in c.runs().tolist()]


@given(st.lists(st.integers(0, 2), max_size=90), st.integers(2, 4), st.integers(2, 7), st.lists(st.integers(0, 90), max_size=6))
@settings(max_examples=300, deadline=None)
def test_runs_are_all_runs(words, exponent, least, cuts):
    want = brute.runs(words, exponent, least)
    assert caught(words, exponent, least) == want
    cuts = sorted(min(c, len(words)) for c in cuts)
    assert caught(words, exponent, least, cuts) == want


@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.integers(2, 9), st.integers(0, 12), st.lists(st.integers(0, 4), max_size=20))
@settings(max_examples=200, deadline=None)
def test_runs_of_longer_periods(unit, times, cut, rest):
    words = rest + unit * times + unit[:cut] + rest[::-1]
    for exponent in (2, 3, 4):
        assert caught(words, exponent, 2) == brute.runs(words, exponent, 2)


def test_one_word_at_a_time():
    words = [0, 1] * 9 + [2] * 7 + [3, 4, 5, 6, 7] * 4 + [8]
    assert caught(words, 2, 2, range(1, len(words))) == brute.runs(words, 2, 2)


@pytest.mark.parametrize("exponent", [2, 4])
def test_runs_of_known_words(exponent):
    thue = [bin(i).count("1") % 2 for i in range(600)]
    fib, nxt = [0], [0, 1]
    while len(nxt) < 600:
        fib, nxt = nxt, nxt + fib
    far = list(range(700)) + list(range(50, 700)) * 3
    for words in (thue, nxt, [5] * 900, far, [1, 2, 3] * 300 + [1], list(range(800)), []):
        assert caught(words, exponent, 2) == brute.runs(words, exponent, 2)


def test_long_run_of_one_word_is_fast():
    assert caught([1] * 200_000, 4, 6) == [(0, 200_000, 1)]


TEXTS = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "b " * 50 + "c", "x y x y " * 5, LONG, LONG, "no run in here at all"]
TEXTS += ["one two three " * 5 + "stop " + "go on " * 4, "ha " * 9 + "ho " * 9, "\x0b\x0c".join(["p q r s"] * 7)]


def test_find_runs(docs, monkeypatch):
    data = list(enumerate(TEXTS)) + [(5, TEXTS[6]), (5, TEXTS[5]), (None, TEXTS[12]), (-3, TEXTS[11])]
    for slab in (1 << 18, 40):
        monkeypatch.setattr(periodic, "SLAB", slab)
        got = {(r["doc_id"], r["n_words"], str(r["runs"]), r["collapsed"]) for r in periodic.find(docs(data)).collect()}
        assert periodic.find(docs(data)).count() == len(data)
        want = set()
        for d, t in data:
            words = (t or "").encode().split()
            found = brute.runs(words, 4, 6) if len(words) < 5000 else [(0, len(words), 997)]
            kept = brute.collapsed([w.decode() for w in words], found)
            want.add((d, len(words), str(found), kept))
        assert {(d, n, str([tuple(x) for x in eval(r.replace("Row", "dict"), {"dict": lambda **k: tuple(k.values())})]), k) for d, n, r, k in got} == want
    assert periodic.find(docs(data).where("false")).collect() == []


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_digest_of_planted_runs(docs):
    r = random.Random(5)
    data = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 90)))) for i in range(250)]
    out = periodic.digest(periodic.find(docs(data), prepare=periodic.plant)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for row in out:
        words = planted(row["doc_id"], data[row["doc_id"]][1].split())
        found = brute.runs(words, 4, 6)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert tuple(row)[:5] == (row["doc_id"], len(found), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert row["collapsed_sha256"] == sha(brute.collapsed(words, found))
    assert len(out) == len(data) and any(row["n_runs"] for row in out)


# ---- hard negatives -----------------------------------------------------------------


def mined(spark, data, **params):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, vec string, dim int, bucket int, shard int")
    vectors = hard_negatives.labelled_vectors(df, df["label"], scale=256)
    return sorted(tuple(r) for r in hard_negatives.mine(vectors, F.col("vec_id") % 20 == 0, **params).collect())


def full(rows):
    return [(i, v, label, "x", 1, 2, 3) for i, v, label in rows]


def test_hard_negatives_against_all_pairs(spark):
    r = random.Random(11)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.3, 0.9]) for _ in range(4)], i % 3 if i % 2 else 0) for i in range(260)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5], i % 4) for i in range(40)]  # equal vectors: ties by id
    rows += [(400, [0.0] * 4, 1), (420, [0.9, 0.1], 1), (421, [0.8, 0.1], 1), (422, [0.8, 0.05], 2), (440, [0.3] * 4, 77)]
    bad = [(500, None, 1), (520, [1.0, None, 0.0, 0.0], 1), (540, [math.nan, 0.0, 0.0, 0.0], 1), (560, [math.inf] * 4, 1), (None, [1.0] * 4, 1), (580, [1.0] * 4, None)]
    again = [(20, [0.9] * 4, 5), (20, [0.8] * 4, 5)]
    good = {i: (label, [float(np.float32(x)) for x in v]) for i, v, label in rows}
    want = brute.hard_negatives(good, lambda i: i % 20 == 0, 5, 3, 50, 95, 256)
    assert len(want) > 50
    # The row of id 20 with the smallest label is the first one.
    for params in ({}, {"shard_rows": 40, "anchor_rows": 3}, {"shard_rows": 40, "most_shards": 2, "most_rows": 90}):
        assert mined(spark, full(rows + bad + again), **params) == want
    assert mined(spark, full(rows)[:0]) == []


def test_hard_negatives_with_large_scores(spark):
    rows = [(i, [float(np.float32(2.0**23 * (i + 1) / 45)), 1.0], i % 2) for i in range(45)]
    good = {i: (label, v) for i, v, label in rows}
    want = brute.hard_negatives(good, lambda i: i % 20 == 0, 5, 3, 50, 95, 256)
    assert max(x[4] for x in want) > 2**60
    assert mined(spark, full(rows), shard_rows=16) == want


def test_lists_are_not_read_to_the_end():
    r = np.random.default_rng(2)
    points = r.integers(-50, 50, (2000, 4))
    points[:20] += 400
    lists = hard_negatives.SortedLists(points, np.arange(2000))
    q = np.array([3, 1, 2, 5])
    every = np.ones(2000, bool)
    got = lists.search(q, every, [(None, None), (900, 1100)], 3)
    scores = points @ q
    for (low, high), best in zip([(None, None), (900, 1100)], got):
        fit = sorted((-s, i) for i, s in enumerate(scores.tolist()) if (low is None or s >= low) and (high is None or s <= high))
        assert best == [(-s, i) for s, i in fit[:3]]
    lists.search(q, every, [(None, None)], 3)
    assert lists.read < 200
    # The first threshold already shows that nothing reaches this window.
    lists.search(q, every, [(10**6, None)], 3)
    assert lists.read == 0
