"""Quality by co-training: a text view and a page-metadata view teach each other.

The text view is what the text itself shows: the distribution of its character-class bigrams (letters, digits,
symbols), hashed to ``BIGRAMS`` columns, its layout (lines, words a line), its shares of capitals, symbols and digits and
the variety of its words. The metadata view is what a crawler knows of a page without reading it: source,
language and size. Each view has a
logistic classifier. In every round each view scores all unlabelled documents, and its confident
ones become pseudo-labels of the other view. At the end both views are calibrated on one half of the labelled
documents held out from training, and a logistic combination of the calibrated views, fitted on the other half, scores
every document.

Classifiers are fitted on bounded samples, drawn by hash: at most ``fit_rows`` labelled documents and
``pseudo_rows`` confident documents of each label, view and round. All scores, priors and the cut cover all
documents. A document is kept if its score is at least ``cut``.

Null texts count as empty, null sources and languages as their own value. Labels that are null or contradict
each other for one document are left out; with fewer than two labels of each class every document
scores the prior and is kept. Null and repeated ids and repeated rows are scored row by row. An empty
table gives no rows. ``keep`` returns all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import trimmed
from vitrine.session import materialize

BIGRAMS, SHAPE = 256, 8
TEXT_DIMS = BIGRAMS + SHAPE
META_HASHED = 32
META_DIMS = 2 * META_HASHED + 3
_SIZE_AT = 2 * META_HASHED + 1
_CLASSES = 48


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte: letters by themselves, capitals, digits, white space, symbols."""
    t = np.full(256, 46, np.int64)  # other symbols
    for i in range(26):
        t[97 + i] = i
        t[65 + i] = 26 + i % 4
    t[48:58] = 30
    t[128:] = 31 + np.arange(128) % 4
    for i, c in enumerate(b" \n.,;:!?|\"'"):
        t[c] = 35 + i
    return t


_TABLE = _class_table()
_FOLD = (np.arange(_CLASSES * _CLASSES) * 2654435761 % 2**32 >> 7) % BIGRAMS


def text_view(data: bytes) -> np.ndarray:
    """Square roots of the shares of the class bigrams, folded to ``BIGRAMS``; then the text's shape."""
    out = np.zeros(TEXT_DIMS, np.float32)
    raw = np.frombuffer(data, np.uint8)
    if len(data) > 1:
        c = _TABLE[raw]
        counts = np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES)
        folded = np.bincount(_FOLD, weights=counts, minlength=BIGRAMS)
        out[:BIGRAMS] = np.sqrt(folded / folded.sum())
    size = max(1, len(data))
    b = np.bincount(raw, minlength=256)
    lines, spaces = b[10] + 1, b[32] + b[10] + 1
    letters = max(1, b[65:91].sum() + b[97:123].sum())
    out[BIGRAMS:] = (
        np.log1p(lines) / 5,
        np.log1p(spaces / lines) / 5,
        size / spaces / 20,
        b[65:91].sum() / letters,
        b[48:58].sum() / size,
        (b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()) / size,
        b[128:].sum() / size,
        _variety(data),
    )
    return out


def meta_view(size: int, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_DIMS, np.float32)
    for k, v in enumerate((lang, source)):
        out[k * META_HASHED + xxhash.xxh32_intdigest(f"{k}:{v}".encode()) % META_HASHED] = 1
    out[2 * META_HASHED :] = (np.log1p(max(0, n_chars or 0)) / 10, np.log1p(max(1, size)) / 10, n_chars is None)
    return out


def _variety(data: bytes) -> float:
    """How many of the words are different, on a log scale: low where words repeat a lot."""
    words = data.split()
    return np.log1p(len(set(words))) / np.log1p(len(words)) if words else 1.0


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic fit by Newton steps."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.ones(len(y)) if w is None else w
    beta = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge * w.sum())
    reg[-1] = 1e-9 * w.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - reg * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        beta += step * min(1.0, 20 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return beta


def margin(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ beta[:-1] + beta[-1]


def damped(tx: np.ndarray, mx: np.ndarray, centre: np.ndarray, half: float = 150.0) -> np.ndarray:
    """A text of ``half`` bytes counts half: its few bigrams say little about its distribution."""
    size = np.expm1(mx[:, _SIZE_AT].astype(np.float64) * 10)[:, None]
    return centre + (tx - centre) * (size / (size + half))


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Weights of both views, their calibrations ``(slope, shift)``, the combination, the prior."""

    text: np.ndarray | None
    meta: np.ndarray | None
    calibrations: tuple | None
    blend: np.ndarray | None
    prior: float = 1.0
    centre: np.ndarray | None = None

    def damped(self, tx: np.ndarray, mx: np.ndarray) -> np.ndarray:
        """Text views drawn to the centre of the labelled ones the shorter the text is."""
        return damped(tx, mx, self.centre)

    def views(self, tx: np.ndarray, mx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of each view."""
        (a, b), (c, d) = self.calibrations
        return a * margin(self.damped(tx, mx), self.text) + b, c * margin(mx, self.meta) + d

    def score(self, tx: np.ndarray, mx: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(tx), self.prior)
        zt, zm = self.views(tx, mx)
        return chance(margin(np.column_stack([zt, zm]), self.blend))


def _vectors(docs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    texts = [(t or b"", lang, source, n) for t, lang, source, n in docs]
    if not texts:
        return np.zeros((0, TEXT_DIMS), np.float32), np.zeros((0, META_DIMS), np.float32)
    return np.stack([text_view(t[0]) for t in texts]), np.stack([meta_view(len(t[0]), *t[1:]) for t in texts])


def _page_columns(docs: DataFrame) -> list:
    """Text as bytes, language, source, size; a column that is missing counts as null."""
    have = docs.columns
    pick = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t)
    return [
        F.col("text").cast("binary").alias("_t"),
        pick("lang", "string").alias("_l"),
        pick("source", "string").alias("_s"),
        pick("n_chars", "long").alias("_n"),
    ]


def _rows(batch: pa.RecordBatch, first: int) -> list[tuple]:
    return list(zip(*[batch.column(first + k).to_pylist() for k in range(4)])) if batch.num_rows else []


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, tx, mx)``: both views as packed float32."""
    cols = docs.select(F.col("doc_id").cast("long"), *_page_columns(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                tx, mx = _vectors(_rows(some, 1))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([r.astype("<f2").tobytes() for r in tx], pa.binary()), pa.array([r.astype("<f2").tobytes() for r in mx], pa.binary())],
                    names=["doc_id", "tx", "mx"],
                )

    return cols.mapInArrow(trimmed(run), "doc_id long, tx binary, mx binary")


def _matrix(rows: list, field: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[field] for r in rows), "<f2").astype(np.float32).reshape(len(rows), dims)


def _confident(docs: DataFrame, known: DataFrame, model: Model, sure: float, rows: int, seed: int) -> list:
    """Of all unlabelled documents that one view is sure of and the other is not against: a hash sample.

    Every document is scored. ``rows`` of each label and view are drawn, by a hash of the id whose cut
    follows from their number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                zt, zm = shared.value.views(*_vectors(_rows(some, 1)))
                for view, z, other in ((0, zt, zm), (1, zm, zt)):
                    for y, p, q in ((1, chance(z), chance(other)), (0, chance(-z), chance(-other))):
                        fit = (p >= sure) & (q > 1 - sure)
                        ids = some.column(0).filter(pa.array(fit))
                        n = len(ids)
                        yield pa.RecordBatch.from_arrays(
                            [ids, pa.array([view] * n, pa.int32()), pa.array([y] * n, pa.int32())],
                            names=["doc_id", "view", "y"],
                        )

    cols = docs.select(F.col("doc_id").cast("long"), *_page_columns(docs))
    ids = cols.mapInArrow(trimmed(run), "doc_id long, view int, y int").where("doc_id is not null")
    ids = materialize(ids.join(known.select("doc_id"), "doc_id", "left_anti"), "quality-sure")
    counts = {(r["view"], r["y"]): r["count"] for r in ids.groupBy("view", "y").count().collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    within = F.lit(False)
    for (view, y), n in counts.items():
        cut = min(1 << 40, int(1.3 * rows / n * (1 << 40)))
        within = within | ((F.col("view") == view) & (F.col("y") == y) & (draw < cut))
    drawn = ids.where(within).select("doc_id", "view", "y", draw.alias("draw")).distinct()
    # A bounded sample by construction: 4 times 1.3 times ``rows`` on average.
    chosen = features(docs.join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id", "left_semi"))
    out = sorted(chosen.join(F.broadcast(drawn), "doc_id").collect(), key=lambda r: (r["draw"], r["doc_id"], r["tx"]))
    taken: dict[tuple[int, int], int] = {}
    kept = []
    for r in out:
        group = (r["view"], r["y"])
        taken[group] = taken.get(group, 0) + 1
        if taken[group] <= rows:
            kept.append(r)
    return kept


def train(
    docs: DataFrame,
    labels: DataFrame,
    rounds: int = 2,
    fit_rows: int = 12_000,
    pseudo_rows: int = 1_000,
    sure: float = 0.97,
    seed: int = 7,
) -> Model:
    """Co-train on ``labels(doc_id, quality)``; see the module's text for the bounds."""
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("y"), F.max("quality").alias("y2"))
        .where("y = y2")
        .select("doc_id", F.col("y").cast("int"))
    )
    prior = known.agg(F.avg("y")).first()[0]
    # Sample by hash of the id before the join: the bound holds whatever the table's size.
    total = known.count()
    share = min(1.0, 1.2 * fit_rows / max(1, total))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # ``picked`` holds 1.2 times ``fit_rows`` on average, so it and its features are small.
    picked = materialize(picked, "quality-picked")
    some = features(docs.join(F.broadcast(picked), "doc_id", "left_semi"))
    labelled = sorted(
        some.join(F.broadcast(picked), "doc_id").collect(),
        key=lambda r: (xxhash.xxh64_intdigest(f"{seed}:{r['doc_id']}".encode()), r["tx"]),
    )[:fit_rows]
    y = np.array([r["y"] for r in labelled], float)
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return Model(None, None, None, None, 1.0 if prior is None else float(prior))
    tx, mx = _matrix(labelled, "tx", TEXT_DIMS), _matrix(labelled, "mx", META_DIMS)
    held = np.array([xxhash.xxh32_intdigest(str(r["doc_id"]).encode()) % 4 == 0 for r in labelled])
    if min((y[held] == 0).sum(), (y[held] == 1).sum(), (y[~held] == 0).sum(), (y[~held] == 1).sum()) < 2:
        held = np.arange(len(y)) % 2 == 0
    # Calibrations and their combination are fitted on different held rows, where both halves have both labels.
    half = np.cumsum(held) % 2 == 0
    halves = (held & half, held & ~half)
    if min(len(set(y[h].tolist())) for h in halves) < 2:
        halves = (held, held)
    extra: dict[int, list] = {0: [], 1: []}  # pseudo-labels that each view learns from
    known = materialize(known, "quality-known")

    centre = tx.mean(axis=0)

    def matrices(rows: list) -> tuple[np.ndarray, np.ndarray]:
        m = _matrix(rows, "mx", META_DIMS)
        return damped(_matrix(rows, "tx", TEXT_DIMS), m, centre), m

    known_x = (damped(tx, mx, centre), mx)

    def fit() -> Model:
        weights = []
        first, second = halves
        for view, x in enumerate(known_x):
            more = extra[view]
            xs = np.vstack([x[~held], matrices(more)[view]]) if more else x[~held]
            ys = np.concatenate([y[~held], [r["y"] for r in more]])
            ws = np.concatenate([np.ones((~held).sum()), np.full(len(more), 0.5)])
            weights.append(logistic(xs, ys, ws))
        cal = []
        for x, beta in zip(known_x, weights):
            b = logistic(margin(x[first], beta)[:, None], y[first], ridge=1e-4)
            if b[0] <= 0:  # the view says nothing about these labels: every document gets their share
                share = float(np.clip(y[first].mean(), 1e-3, 1 - 1e-3))
                b = np.array([0.0, np.log(share / (1 - share))])
            cal.append((float(b[0]), float(b[1])))
        model = Model(weights[0], weights[1], tuple(cal), None, float(prior), centre)
        z = np.column_stack(model.views(tx[second], mx[second]))
        model.blend = logistic(z, y[second], ridge=1e-4)
        return model

    model = fit()
    for turn in range(rounds):
        new = _confident(docs, known, model, sure, pseudo_rows, seed + turn)
        if not new:
            break
        for r in new:
            extra[1 - r["view"]].append(r)
        model = fit()
    return model


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, keep)`` per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    cols = docs.select(F.col("doc_id").cast("long"), *_page_columns(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                tx, mx = _vectors(_rows(some, 1))
                s = m.score(tx, mx)
                zt, zm = m.views(tx, mx) if m.text is not None else (np.full(len(s), 30.0), np.full(len(s), 30.0))
                cols = [pa.array(np.round(v, 6)) for v in (chance(zt), chance(zm), s)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *cols, pa.array(s >= cut if m.text is not None else np.ones(len(s), bool))],
                    names=["doc_id", "text_score", "meta_score", "score", "keep"],
                )

    return cols.mapInArrow(trimmed(run), "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if model.text is None:
        return docs
    n = len(docs.columns)
    at = [docs.columns.index(c) if c in docs.columns else None for c in ("text", "lang", "source", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                cols = [[None] * some.num_rows if i is None else some.column(i).to_pylist() for i in at]
                rows = [(None if t is None else t.encode(), la, so, n_) for t, la, so, n_ in zip(*cols)]
                yield some.filter(pa.array(m.score(*_vectors(rows)) >= cut, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema) if n else docs
