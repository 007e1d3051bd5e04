"""Quality rules: counted base rules, and a hashed n-gram logistic regression.

The model sees hashed word 1-2-grams and hashed code point 3-5-grams of a whole text, each feature
family as shares of its occurrences, so a long text is judged by its mix and not by its length.
It is fitted on at most ``max_train`` labelled rows (those of smallest hashed id, as many as ``TRAIN_BYTES`` hold, none
over ``TRAIN_TEXT`` bytes) with a ridge, by L-BFGS; every fifth of them, by hash, is held back for the calibration: Platt's two parameters of
the standardised score, found by Newton steps that are halved until the log loss falls.  Texts are
scored in Arrow batches against a fixed threshold.

Defined cases: a null text has no words; an empty or word-less text fails the base rule; a null
label is not learned from; a label repeated or contradicted for a document keeps its smallest
quality; the order of rows doesn't matter; with labels of one kind only (or none) the model accepts
everything; with one kind only among those held back, all rows calibrate; repeated rows are judged
one by one; columns beyond the named ones are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .tables import table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_AT = 0.5
MAX_TRAIN = 4000
#: Bytes of texts that come to the driver for the fit, and of one such text.
TRAIN_BYTES, TRAIN_TEXT = 64 << 20, 1 << 20
BITS = 17
CHARS = (3, 4, 5)
RIDGE = 1e-4
STEPS = 40
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _dup_lines(w: V.Words) -> np.ndarray:
    """Per row, lines that hold a word and equal an earlier line of the row."""
    n = len(w.rows) - 1
    if not len(w.data):
        return np.zeros(n, np.int64)
    newline = w.data == 10
    begin = np.zeros(len(w.data), dtype=bool)
    begin[1:] = newline[:-1]
    begin[w.rows[:-1][w.rows[:-1] < len(w.data)]] = True
    starts = np.flatnonzero(begin)
    gap = np.diff(starts, append=len(w.data))
    place = np.arange(len(w.data)) - np.repeat(starts, gap)
    value = (w.data.astype(V.U) + V.U(1)) * V.powers(V._BASE2, int(gap.max()))[place]
    value[newline] = 0
    h = V.mix(np.add.reduceat(value, starts))
    has_word = np.add.reduceat((~w.space).astype(np.int64), starts) > 0
    row = np.searchsorted(w.rows, starts, side="right") - 1
    row, h = row[has_word], h[has_word]
    keys = h ^ V.mix(row.astype(V.U))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def _repeat_words(w: V.Words, wh: np.ndarray, k: int = 5) -> np.ndarray:
    """Per row, words inside a k-word window that occurs twice or more in the row."""
    n = len(w.rows) - 1
    at, row = V.gram_rows(w.bounds, k)
    if not len(at):
        return np.zeros(n, np.int64)
    keys = V.grams(wh, k)[at] ^ V.mix(row.astype(V.U))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(wh) + 1, np.int64)
    hit = at[twice]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + k, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return V.row_sums(covered, w.bounds)


def count_rules(w: V.Words, wh: np.ndarray) -> dict[str, np.ndarray]:
    chars = ((w.data & 0xC0) != 0x80) & ~w.space
    return {
        "n_words": w.counts,
        "word_chars": V.row_sums(chars, w.rows),
        "n_symbols": V.row_sums(_SYMBOL[w.data], w.rows),
        "n_dup_lines": _dup_lines(w),
        "n_repeat_words": _repeat_words(w, wh),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def _points(w: V.Words) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each code point, its UTF-8 bytes; bounds of the rows)."""
    lead = (w.data & 0xC0) != 0x80
    lead[w.rows[:-1][w.rows[:-1] < len(w.data)]] = True
    at = np.flatnonzero(lead)
    size = np.diff(at, append=len(w.data))
    value = w.data[at].astype(V.U)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        value[more] = value[more] << V.U(8) | w.data[at[more] + k]
    return value, np.searchsorted(at, w.rows)


def _features(w: V.Words, wh: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(family, row, bucket) of the feature occurrences of a slice, each kind by row."""
    shift = V.U(64 - BITS)
    yield 0, np.repeat(np.arange(len(w.counts)), w.counts), (wh >> shift).astype(np.int32)
    at, row = V.gram_rows(w.bounds, 2)
    yield 0, row, (V.grams(wh, 2)[at] >> shift).astype(np.int32)
    points, bounds = _points(w)
    row = np.repeat(np.arange(len(w.counts)), np.diff(bounds))
    sums, power = points.copy(), 1
    for k in range(1, max(CHARS)):
        if len(points) <= k:
            break
        power = power * V._BASE1 & 0xFFFFFFFFFFFFFFFF
        sums = sums[:-1] + points[k:] * V.U(power)
        if k + 1 in CHARS:
            inside = row[: len(sums)] == row[k:]
            bucket = ((sums[inside] ^ V.U(k)) * V.U(V._BASE2) >> shift).astype(np.int32)
            yield 1, row[: len(sums)][inside], bucket + np.int32(1 << BITS)


def linear_scores(w: V.Words, wh: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """weights . x + bias, x the shares of each family's occurrences."""
    n = len(w.counts)
    total, count = np.zeros((2, n)), np.zeros((2, n))
    for family, row, bucket in _features(w, wh):
        edge = np.searchsorted(row, np.arange(n + 1))
        run = np.concatenate([[0.0], np.cumsum(weights[bucket], dtype=np.float64)])
        total[family] += run[edge[1:]] - run[edge[:-1]]
        count[family] += np.diff(edge)
    return bias + (total / np.maximum(count, 1)).sum(0)


class Model:
    """Weights, bias, calibration (a, b): probability = 1 / (1 + exp(-(a * score + b)))."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def probability(self, w: V.Words, wh: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * linear_scores(w, wh, self.weights, self.bias) + self.b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    """Summed log loss of scores; targets may lie between 0 and 1."""
    return float((np.logaddexp(0, z) - y * z).sum())


class _Shares:
    """Training rows as sparse shares, a slice of texts at a time."""

    def __init__(self, texts: list[str]):
        self.parts = []
        raw, offs, _ = V.column(pa.array(texts, pa.large_string()))
        norm = np.zeros(2)
        for i, j in V.slices(offs):
            w = V.split(raw, offs, i, j)
            seen = list(_features(w, w.hashes()))
            for family in (0, 1):
                key = np.concatenate([row << 32 | bucket for f, row, bucket in seen if f == family] or [np.zeros(0, np.int64)])
                key, n = np.unique(key, return_counts=True)
                row = key >> 32
                share = n / np.bincount(row, weights=n, minlength=j - i)[row]
                norm[family] += (share**2).sum()
                start = np.flatnonzero(np.diff(row, prepend=-1))
                self.parts.append((family, (row[start] + i).astype(np.int64), start, (key & 0xFFFFFFFF).astype(np.int32), share.astype(np.float32)))
        #: Families are brought to one mean square length.
        self.scale = 1 / np.sqrt(np.maximum(norm / max(len(texts), 1), 1e-12))
        self.rows = len(texts)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows)
        for family, row, start, col, share in self.parts:
            if len(row):
                out[row] += np.add.reduceat(weights[col] * share, start) * self.scale[family]
        return out

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for family, row, start, col, share in self.parts:
            if len(row):
                each = np.repeat(g[row] * self.scale[family], np.diff(start, append=len(col)))
                out += np.bincount(col, weights=each * share, minlength=size)
        return out


def _minimise(f, x: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS with steps halved until the value falls enough; ``f`` gives value and gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -grad, []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), alpha in zip(past, reversed(alphas)):
            d = d + s * (alpha - r * (y @ d))
        slope, t = float(grad @ d), 1.0
        while t > 1e-6:
            new_value, new_grad = f(x + t * d)
            if new_value <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, new_grad - grad
        x, done = x + s, value - new_value < 1e-4 * max(abs(value), 1e-9)
        value, grad = new_value, new_grad
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y, 1 / float(s @ y))]
        if done:
            break
    return x


def calibrate(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's (a, b) for scores z of labelled rows, unweighted, with his smoothed targets."""
    middle, spread = float(z.mean()), float(z.std()) or 1.0
    x = (z - middle) / spread
    good, bad = int(labels.sum()), int(len(labels) - labels.sum())
    y = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 0.0, float(np.log((good + 1) / (bad + 1)))
    loss = _log_loss(a * x + b, y)
    for _ in range(100):
        p = _sigmoid(a * x + b)
        h, g = p * (1 - p), p - y
        ga, gb, haa, hab, hbb = (g * x).sum(), g.sum(), (h * x * x).sum() + 1e-9, (h * x).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        t = 1.0
        while t > 1e-9 and (new := _log_loss((a - t * da) * x + b - t * db, y)) > loss:
            t /= 2
        if t <= 1e-9:
            break
        a, b, fell, loss = a - t * da, b - t * db, loss - new, new
        if fell < 1e-9 * max(loss, 1e-9):
            break
    a = max(a, 0.0)  # a score never counts against itself
    return a / spread, b - a * middle / spread


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Ridge logistic regression on four fifths of the rows, Platt calibration on the other."""
    size = 2 << BITS
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(size), 10.0, 1.0, 0.0)
    # By a hash of text and label: the same rows in any order give the same model.
    order = sorted(range(len(texts)), key=lambda k: hashlib.sha256(f"{labels[k]}{texts[k]}".encode("utf-8", "surrogatepass")).digest())
    texts, labels = [texts[k] for k in order], np.asarray(labels)[order]
    held = np.arange(len(labels)) % 5 == 4
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held[:] = False
    x, use = _Shares(texts), (~held).astype(float)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = v[:-1], v[-1]
        z = x.dot(w) + b
        g = use * (_sigmoid(z) - labels) / use.sum()
        value = (use * (np.logaddexp(0, z) - labels * z)).sum() / use.sum() + ridge / 2 * (w @ w)
        return float(value), np.append(x.back(g, size) + ridge * w, g.sum())

    v = _minimise(loss, np.zeros(size + 1), steps)
    fold = held if held.any() else ~held
    a, b = calibrate((x.dot(v[:-1]) + v[-1])[fold], labels[fold])
    weights = v[:-1] * np.repeat(x.scale, 1 << BITS)
    return Model(weights.astype(np.float32), float(v[-1]), a, b)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the ``max_train`` labelled documents of smallest hashed id, one text (the smallest) each;
    only those texts move."""
    order = F.xxhash64("doc_id")
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = one.orderBy(order, "doc_id").limit(max_train)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").where(F.octet_length("text") <= TRAIN_TEXT)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    held, found = 0, []
    for r in rows.orderBy(order, "doc_id").toLocalIterator():  # a part at a time, as far as the bound goes
        held += len(r.text.encode("utf-8", "surrogatepass"))
        if held > TRAIN_BYTES:
            break
        found.append((r.text, int(r.quality > 0)))
    return fit([t for t, _ in found], np.array([q for _, q in found], dtype=np.int64))


def score(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the five counts, base_failed, probability and kept, one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS) + ", base_failed boolean, probability double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offs, _ = V.column(batch.column(1))
            for i, j in V.slices(offs):
                w = V.split(raw, offs, i, j)
                wh = w.hashes()
                counts = count_rules(w, wh)
                failed, p = base_failed(counts), m.probability(w, wh)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(counts[c], pa.int64()) for c in COLUMNS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))],
                    ["doc_id", *COLUMNS, "base_failed", "probability", "kept"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
