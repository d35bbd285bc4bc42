"""Near copies by Order MinHash, verified by banded alignment.

Texts are words in lower case. Their five-word runs are labelled by occurrence; each of ``sketches`` hash
orders picks its two smallest and keeps them in text order, so that a sketch agrees only where both
the runs and their order do. Texts that agree in a sketch form a bucket. In each bucket the texts are paired
with the text of the smallest id.
Pairs are verified by alignment: similarity is 1 - edits / longer length in words, the band holds the
edits allowed; pairs that share too few word pairs to align are dropped before, exactly.

Links are joined to classes; buckets that still hold several classes are looked at again. Up to ``crowd`` texts
are paired each with each of another class; of larger buckets with up to ``crowd`` classes the smallest ids of
the classes are paired, and classes joined. All texts of larger buckets that hold several classes even then
are paired by a prefix filter: texts alike must share one of their rarest words (so many that it
follows from the edits allowed), whatever common passage brought them together. So every link between
texts of a bucket joins their classes, and no list of all pairs of a large bucket is made. Texts with the
same words are one text before all this and share its class.

Null texts are empty. A text without words is alone in its class; under five words the whole text is
its one run. Rows with a null id are left out of classes (class null). Rows that repeat an id are one
document if their words are the same; each other text of an id is a document of its own, with that id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import U64, gram_hashes, mix, small, text_key, trimmed, word_hashes
from vitrine.llm.components import components
from vitrine.session import materialize

ROWS = 2_000_000  # hashes of a sketch drawn at once
SHORT = 1_000  # words up to which the band is aligned at once
FEW = 40  # edits looked for one diagonal at a time in longer texts
LONG = 30_000  # words beyond which the bit masks of all words would be large
SLOTS = 1 << 20  # counters that order the words by rarity


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def labelled_runs(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words, the n-th occurrence of a run unlike the others."""
    h = word_hashes(words)
    g = gram_hashes(h, min(k, max(1, len(h))))
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    occ = np.empty(len(s), U64)
    occ[order] = nth.astype(U64)
    return mix(g + occ * U64(0x9E3779B97F4A7C15))


def order_minhash(runs: np.ndarray, sketches: int) -> np.ndarray:
    """Per sketch a key of the two smallest runs in text order."""
    seeds = mix(np.arange(1, sketches + 1).astype(U64) * U64(0xA24BAED4963EE407))
    keys = np.empty(sketches, U64)
    top = U64(2**64 - 1)
    step = max(1, ROWS // max(1, len(runs)))
    for lo in range(0, sketches, step):
        # One multiplication orders the runs anew; they are well mixed already.
        v = runs[None, :] * (seeds[lo : lo + step, None] | U64(1))
        v ^= v >> U64(32)
        rows = np.arange(len(v))
        picks = []
        for _ in range(2):
            i = v.argmin(axis=1)
            picks.append(i)
            v[rows, i] = top
        one, two = np.minimum(picks[0], picks[1]), np.maximum(picks[0], picks[1])
        keys[lo : lo + step] = mix(mix(runs[one] + seeds[lo : lo + step]) * U64(3) + runs[two])
    return keys


def _enough_shared(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Exact filter: ``most`` edits leave at least so many common words, runs of two and runs of three words."""
    for k in (1, 2, 3):
        needed = max(len(a), len(b)) - k + 1 - k * most
        if needed <= 0:
            continue
        x, y = np.sort(gram_hashes(a, k)), np.sort(gram_hashes(b, k))
        values, counts = np.unique(x, return_counts=True)
        there = np.searchsorted(y, values, "right") - np.searchsorted(y, values, "left")
        if int(np.minimum(counts, there).sum()) < needed:
            return False
    return True


def _few_edits(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance up to a small ``most``: furthest-reaching points, one diagonal at a time."""
    n, m = len(a), len(b)
    off = most + 1
    far = [-2] * (2 * most + 3)
    far[off] = -1
    for d in range(most + 1):
        new = [-2] * (2 * most + 3)
        for k in range(max(-d, -n), min(d, m) + 1):
            at = off + k
            x = max(far[at] + 1, far[at + 1] + 1, far[at - 1]) if d else 0
            if x < 0 or x + k < 0:
                continue
            x = min(x, n, m - k)
            while x < n and x + k < m and a[x] == b[x + k]:
                x += 1
            new[at] = x
            if x >= n and x + k >= m:
                return d
        far = new
    return None


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences of word hashes if it is at most ``most``, else None.

    Long texts are first tried with a few edits, one diagonal at a time. Then the band that holds every
    alignment of ``most`` edits is computed column by column, its cells as the bits of whole numbers
    (``_banded``). Texts beyond ``LONG`` words take a band of furthest-reaching points that grows until it
    holds the distance, which needs memory in proportion to the text (``_within``).
    """
    if abs(len(a) - len(b)) > most:
        return None
    if len(a) > len(b):
        a, b = b, a
    same = min(len(a), len(b))
    if same:
        diff = np.flatnonzero(a != b[:same])
        head = int(diff[0]) if len(diff) else same
        a, b = a[head:], b[head:]
        same = min(len(a), len(b))
        diff = np.flatnonzero(a[len(a) - same :][::-1] != b[len(b) - same :][::-1])
        tail = int(diff[0]) if len(diff) else same
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n:
        return m if m <= most else None
    if m > SHORT:
        few = min(most, FEW)
        if m - n <= few:
            found = _few_edits(a.tolist(), b.tolist(), few)
            if found is not None or few == most:
                return found
    if m <= LONG:
        return _banded(a.tolist(), b.tolist(), most)
    band = min(most, max(200, m - n))
    while True:
        found = _within(a, b, band)
        if found is not None or band >= most:
            return found
        band = min(most, 4 * band)


def _banded(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance up to ``most`` by the bit-parallel recurrence on a diagonal band (Myers, Hyyroe).

    ``a`` is not longer than ``b``. Bit i of column j stands for row ``j - above + i``. An alignment of
    ``most`` edits stays within ``over`` diagonals beside those that join both corners.
    """
    n, m = len(a), len(b)
    gap = m - n
    if gap > most:
        return None
    over = min((most - gap) // 2, n)
    above = gap + over
    low = above + over  # the bit of the lowest row
    mask = (2 << low) - 1
    rows: dict[int, int] = {}
    for i, word in enumerate(a):
        rows[word] = rows.get(word, 0) | 1 << i
    # Vertical steps of column 0, seen from column 1: +1 below row 0.
    up = mask >> above << above
    down = 0
    score = over  # of the band's lowest row, later of row n
    bit = low
    for j, word in enumerate(b, 1):
        shift = j - 1 - above
        same = rows.get(word, 0)
        if same:
            same = (same >> shift if shift > 0 else same << -shift) & mask
        flat = ((((same & up) + up) ^ up) | same | down) & mask  # no step along the diagonal
        right = (down | ~(flat | up)) & mask
        left = flat & up
        if j <= n - over:
            if not flat >> low:
                score += 1
        else:
            bit -= 1
            score += (right >> bit & 1) - (left >> bit & 1)
        # The score never falls along a diagonal, and by one at most with each column along row n.
        if score > most + min(above, m - j):
            return None
        flat >>= 1
        up = (left | ~(flat | right)) & mask
        down = flat & right
    return score if score <= most else None


def _within(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    n, m = len(a), len(b)
    diag = np.arange(-band, band + 1)
    base = U64(0x9E3779B97F4A7C15)
    size = max(n, m) + 1
    powers = np.ones(size, U64)
    np.cumprod(np.full(size - 1, base, U64), out=powers[1:])
    ha = np.concatenate([np.zeros(1, U64), np.cumsum(a * powers[:n])])
    hb = np.concatenate([np.zeros(1, U64), np.cumsum(b * powers[:m])])

    def slide(x):
        y = x + diag
        ok = (x >= 0) & (x <= n) & (y >= 0) & (y <= m)
        xs, ys = np.where(ok, x, 0), np.where(ok, y, 0)
        low, high = np.zeros_like(x), np.where(ok, np.minimum(n - xs, m - ys), 0)
        while (low < high).any():
            mid = (low + high + 1) // 2
            eq = (ha[xs + mid] - ha[xs]) * powers[ys] == (hb[ys + mid] - hb[ys]) * powers[xs]
            low, high = np.where(eq, mid, low), np.where(eq, high, mid - 1)
        return np.where(ok, x + low, x)

    far = np.full(len(diag), -(1 << 40))
    far[band] = 0
    far = np.where(far >= 0, slide(far), far)
    goal = m - n + band
    for d in range(band + 1):
        if far[goal] >= n:
            return d
        nxt = far + 1  # substitution
        nxt[:-1] = np.maximum(nxt[:-1], far[1:] + 1)  # a word of a dropped
        nxt[1:] = np.maximum(nxt[1:], far[:-1])  # a word of b put in
        nxt = np.minimum(nxt, np.minimum(n, m - diag))
        far = np.where((nxt >= 0) & (nxt + diag >= 0), slide(nxt), -(1 << 40))
    return None


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Are two texts, as hashes of their words, at least so similar?"""
    most = int((1 - least) * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    return _enough_shared(x, y, most) and edits(x, y, most) is not None


def profiles(docs: DataFrame, k: int, sketches: int) -> DataFrame:
    """``(doc_id, fp, n, keys, tk)`` per row: print of the words, word count, sketches, key of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                prints, counts, keys = [], [], []
                for text in some.column(1).to_pylist():
                    words = words_of(text)
                    prints.append(xxhash.xxh128_digest(b" ".join(words)))
                    counts.append(len(words))
                    if words:
                        keys.append(order_minhash(labelled_runs(words, k), sketches).view(np.int64))
                    else:
                        keys.append(np.empty(0, np.int64))
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, lists), some.column(2)],
                    names=["doc_id", "fp", "n", "keys", "tk"],
                )

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(F.col("text").cast("string")))
    return cols.mapInArrow(trimmed(run), "doc_id long, fp binary, n long, keys array<long>, tk long")


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``(_id, _t)`` of the ids ``_id``, written; of rows that repeat an id the smallest text stands for it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_t"))
    texts = texts.where("_id is not null")  # one text an id, up to white space: see ``_classes_by_text``
    needed = small(materialize(ids, "pair-ids"))
    return materialize(
        texts.join(needed, "_id", "left_semi").groupBy("_id").agg(F.min("_t").alias("_t")), "pair-texts"
    )


def _verified(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts align."""
    ids = [pairs.select(F.col(c).alias("_id")).distinct() for c in ("a", "b")]
    texts = _texts(ids[0].unionByName(ids[1]).distinct(), docs)
    rows = pairs.join(texts.withColumnsRenamed({"_id": "a", "_t": "ta"}), "a").join(
        texts.withColumnsRenamed({"_id": "b", "_t": "tb"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                known: dict[int, np.ndarray] = {}  # texts of these rows; leaders stand in many
                ok = []
                for a, b, ta, tb in zip(*(some.column(i).to_pylist() for i in range(4))):
                    for i, text in ((a, ta), (b, tb)):
                        if i not in known:
                            known[i] = word_hashes(words_of(text))
                    ok.append(alike(known[a], known[b], least))
                yield some.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return rows.select("a", "b", "ta", "tb").mapInArrow(trimmed(run), "a long, b long")


EACH = 100  # words of a text for which its prefix holds one word more, and two texts must share one more


def prefix_of(runs: np.ndarray, n: int, counts: np.ndarray, k: int, least: float) -> np.ndarray:
    """The rarest runs of a text of ``n`` words, of which every text alike shares ``1 + n // EACH`` among its own.

    Texts alike have ``needed`` labelled runs of ``k`` words in common at least. Take the one whose first
    ``len(runs) - needed + m`` runs, in one order for all texts, end first: what follows them holds ``needed - m`` runs, so
    ``m`` common ones at least stand among them, and among the other's, which end later. Runs that no other text has
    are left out.
    """
    seen = counts[(runs % U64(SLOTS)).astype(np.int64)]
    needed = max(1, math.ceil(n * (1 - k * (1 - least)) - (k - 1) - 1e-6))
    first = np.lexsort((runs, seen))[: max(0, len(runs) - needed + 1 + n // EACH)]
    return runs[first][seen[first] > 1]


def _sharing(held: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Pairs ``(d, o, n, on)`` of the texts ``held(d, root)``, of unlike roots, that may align: an exact filter.

    The order of the runs is their count among these texts, summed in ``SLOTS`` slots by hash.
    """
    # Single words: one edit changes one of them, but two runs of two words. So more of them must be shared
    # and the prefix is half as long; what a common passage brings into all texts lies beyond it for the most part.
    k = 1
    held = materialize(held, "near-held")
    texts = _texts(held.select(F.col("d").alias("_id")).distinct(), docs)
    texts = materialize(texts.join(held.withColumnRenamed("d", "_id"), "_id"), "near-rooted-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                split = map(words_of, batch.column(0).slice(low, 512).to_pylist())
                runs = np.concatenate([np.empty(0, U64), *(labelled_runs(words, k) for words in split if words)])
                total += np.bincount((runs % U64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    table = texts.select("_t").mapInArrow(trimmed(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        sizes = [len(p) for _, _, _, p in found]
        each = [pa.array(np.repeat(np.array([t[i] for t in found], np.int64), sizes)) for i in range(3)]
        own = [p if n <= SHORT else None for (_, _, n, p), size in zip(found, sizes) for _ in range(size)]
        runs = pa.array(np.concatenate([np.empty(0, np.int64), *(p for _, _, _, p in found)]))
        return pa.RecordBatch.from_arrays([*each, runs, pa.array(own, pa.list_(pa.int64()))], names=["d", "root", "n", "run", "own"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                for d, text, root in zip(*(batch.column(i).slice(low, 64).to_pylist() for i in range(3))):
                    words = words_of(text)
                    if not words:
                        continue
                    own = prefix_of(labelled_runs(words, k), len(words), sent.value, k, least).view(np.int64)
                    found.append((d, root, len(words), own))
                    held += len(own) * (len(own) if len(words) <= SHORT else 4)
                    if held > 1_000_000:
                        yield rows_of(found)
                        found, held = [], 0
        if found:
            yield rows_of(found)

    runs = texts.select("_id", "_t", "root").mapInArrow(trimmed(prefixes), "d long, root long, n long, run long, own array<long>")
    runs = materialize(runs, "near-prefixes")
    names = {"d": "o", "n": "on", "root": "oroot", "own": "theirs", "run": "orun"}
    fits = F.abs(F.col("n") - F.col("on")) <= (1 - least) * F.greatest("n", "on") + 1e-9
    same = (F.col("run") == F.col("orun")) & (F.col("d") < F.col("o")) & (F.col("root") != F.col("oroot")) & fits
    least_shared = 1 + F.floor(F.least("n", "on") / EACH)
    # Short texts carry their whole prefixes into the join: a pair leaves it once, at the smallest run that both
    # hold, and only if they share enough. So a run that many texts hold makes no row for each two of them.
    short = runs.where("own is not null")
    shared = F.array_intersect("own", "theirs")
    enough = (F.size(shared) >= least_shared) & (F.array_min(shared) == F.col("run"))
    met = short.join(short.withColumnsRenamed(names), same & enough).select("d", "o", "n", "on")
    # Prefixes of long texts are too long for that; what they share is counted.
    long = runs.where(F.col("n") >= math.floor(least * SHORT)).drop("own")
    counted = long.join(long.withColumnsRenamed({c: x for c, x in names.items() if c != "own"}), same & (F.greatest("n", "on") > SHORT))
    counted = counted.groupBy("d", "o", "n", "on").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    return met.unionByName(counted.drop("shared"))


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """``joined(node, root)`` with the classes that ``links(a, b)`` connect made one."""
    # Only classes are joined: a link between two texts is one between their roots.
    of = joined.select(F.col("node"), "root")
    up = links.join(of.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(
        of.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left"
    )
    up = up.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
    higher = components(up).select(F.col("node").alias("root"), F.col("root").alias("top"))
    ids = joined.select("node", "root").unionByName(up.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    roots = ids.join(higher, "root", "left").groupBy("node").agg(F.min(F.coalesce("top", "root")).alias("root"))
    return materialize(roots, "near-classes")


def classes(docs: DataFrame, **params) -> DataFrame:
    """``(doc_id, class_id, n_words)`` per row of ``docs``; the class id is its smallest doc_id."""
    return labelled(docs, **params).drop("tk")


def labelled(
    docs: DataFrame, least: float = 0.8, k: int = 5, sketches: int = 80, crowd: int = 16
) -> DataFrame:
    """``classes`` with ``tk``, the key of the row's text."""
    prof = materialize(profiles(docs, k, sketches), "near-profiles")
    known = prof.where("doc_id is not null and n > 0")
    twice = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi")
    twice = materialize(twice.select("doc_id"), "near-twice")
    if not twice.isEmpty():
        return _classes_by_text(docs, known.join(twice, "doc_id").select("doc_id", "fp", "tk"), least, k, sketches, crowd)
    # Group minima are written before they are joined back: both sides of the join are then dealt
    # anew, and Spark can split the rows of a hot group over tasks.
    same = prof.where("doc_id is not null and n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    same = materialize(same, "near-same")
    reps = prof.where("n > 0").join(same, (prof["fp"] == same["fp"]) & (prof["doc_id"] == same["rep"]), "left_semi")
    reps = reps.dropDuplicates(["doc_id", "fp"])
    rows = reps.select(F.col("doc_id").alias("d"), "n", F.posexplode("keys").alias("j", "x")).select(
        "d", "n", F.xxhash64("j", "x").alias("key")
    )
    lead = rows.groupBy("key").agg(F.min(F.struct("d", "n")).alias("o"), F.count("*").alias("c")).where("c > 1")
    lead = materialize(lead.select("key", F.col("o.d").alias("o"), F.col("o.n").alias("on")), "near-leaders")
    rows = materialize(rows.join(lead, "key"), "near-buckets")

    def to_test(p: DataFrame) -> DataFrame:
        # Length filter: fewer edits than the difference in length cannot align them.
        fits = F.abs(F.col("n") - F.col("on")) <= (1 - least) * F.greatest("n", "on") + 1e-9
        return p.where((F.col("d") != F.col("o")) & fits).select(F.least("d", "o").alias("a"), F.greatest("d", "o").alias("b")).distinct()

    pairs = materialize(to_test(rows), "near-pairs")
    links = materialize(_verified(pairs, docs, least), "near-links")
    joined = materialize(components(links), "near-roots")

    def rooted(held: DataFrame, roots: DataFrame) -> DataFrame:
        held = held.join(roots.withColumnRenamed("node", "d"), "d", "left")
        return held.withColumn("root", F.coalesce("root", "d"))

    # Buckets that still hold several classes.
    placed = materialize(rooted(rows.select("key", "d", "n"), joined), "near-placed")
    # Written, so that the joins below meet one row a class and not the bucket's texts.
    members = placed.groupBy("key", "root").agg(F.min(F.struct("d", "n")).alias("o"), F.count("*").alias("m"))
    members = materialize(members, "near-members")
    sizes = members.groupBy("key").agg(F.count("*").alias("held"), F.sum("m").alias("m")).where("held > 1")
    sizes = materialize(sizes, "near-bucket-sizes")
    heads = members.select("key", "root", F.col("o.d").alias("d"), F.col("o.n").alias("n"))
    # At most ``crowd`` texts: each with each of another class. At most ``crowd`` classes: their smallest ids.
    few = placed.join(sizes.where(F.col("m") <= crowd), "key", "left_semi")
    heads = heads.join(sizes.where((F.col("m") > crowd) & (F.col("held") <= crowd)), "key", "left_semi")
    some = materialize(few.select("key", "root", "d", "n").unionByName(heads), "near-some")
    other = some.withColumnsRenamed({"root": "oroot", "d": "o", "n": "on"})
    cross = some.join(other, "key").where("root <> oroot and d < o")
    more = materialize(to_test(cross).join(pairs, ["a", "b"], "left_anti"), "near-more-pairs")
    joined = _merged(joined, materialize(_verified(more, docs, least), "near-more-links"))

    # Larger buckets that hold several classes even now: all their texts, by an exact filter. The classes of a bucket
    # tell which buckets these are; its texts are read once.
    large = members.join(sizes.where(F.col("m") > crowd), "key", "left_semi").select("key", F.col("root").alias("d"))
    split = rooted(large, joined).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    held = placed.join(materialize(split.select("key"), "near-split"), "key", "left_semi").select("d").distinct()
    held = rooted(held, joined).select("d", "root")
    tested = pairs.unionByName(more)
    last = materialize(to_test(_sharing(held, docs, least)).join(tested, ["a", "b"], "left_anti"), "near-last-pairs")
    roots = _merged(joined, materialize(_verified(last, docs, least), "near-last-links"))

    rep_class = same.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "rep").alias("class_id")
    )
    out = prof.join(rep_class, (F.col("fp") == F.col("_fp")) & (F.col("n") > 0), "left")
    return out.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.col("n").alias("n_words"),
        "tk",
    )


def _classes_by_text(docs: DataFrame, twice: DataFrame, *params) -> DataFrame:
    """``labelled`` where ids stand for several texts, ``twice(doc_id, fp, tk)``: such a text is a node of its own.

    A node's number is a hash of id and words, far below the ids.
    """
    node = -(F.xxhash64("doc_id", "fp").bitwiseAND(2**61 - 1) + 2**62)
    nodes = materialize(twice.select("doc_id", F.col("tk").alias("_tk"), node.alias("_node")).distinct(), "near-nodes")
    nodes = nodes.withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.join(nodes, (rows["doc_id"] == nodes["_id"]) & (text_key(rows["text"]) == nodes["_tk"]), "left")
    named = named.select("doc_id", F.coalesce("_node", "doc_id").alias("node"), "text")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    named = materialize(named.withColumn("n", words), "near-named")
    inner = labelled(named.select(F.col("node").alias("doc_id"), "text"), *params).where("doc_id is not null and n_words > 0")
    inner = materialize(inner.groupBy("doc_id").agg(F.min("class_id").alias("root")), "near-inner")
    placed = named.join(inner.withColumnRenamed("doc_id", "node"), "node", "left")
    # A text without words is alone, whatever other text its id has.
    placed = materialize(placed.withColumn("root", F.when(F.col("n") > 0, F.col("root"))), "near-rows")
    least_id = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = placed.join(materialize(least_id, "near-least"), "root", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("n").alias("n_words"), text_key("text").alias("tk"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents whose class has a smaller id; all columns stay."""
    gone = labelled(docs, **params).where("class_id < doc_id").select(F.col("doc_id").alias("_gone"), F.col("tk").alias("_tk"))
    gone = materialize(gone.distinct(), "near-gone")
    same = (docs["doc_id"].cast("long") == gone["_gone"]) & (text_key(docs["text"].cast("string")) == gone["_tk"])
    return docs.join(gone, same, "left_anti")
