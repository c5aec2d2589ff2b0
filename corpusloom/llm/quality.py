"""Quality classifier: Naive Bayes support vectors.

Indicators of word unigrams and bigrams (hashed to 2^20 places) are scaled by the
log-count ratio of the two classes; a linear hinge-loss model is fit on them by dual
coordinate descent; its margin becomes a probability by a logistic fit on margins
from cross-validation. Training takes at most MOST labelled rows (picked by a hash of
the id), gathered as hashed features; scoring streams every whole text once, with no
shuffle, against an 8 MB weight table.

Defined cases: null texts count as empty, and an empty text gets the score of the
bias alone; null ids get held_out null and are scored; without labels of both
classes every score is the training rate of label 1 (0.5 with no labels).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, kept, map_text, release, spread
from .labelled import BITS, MARKS, Tokens, batches_of, fold, grams, map_features, platt, sample_ids, sigmoid, sums

MOST = 12_000
PASSES = 12


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for lo, part in batches_of(texts):
            text, total, n = sums(self.weights, *features(part))
            out[lo + text] += total / np.sqrt(n)
        return sigmoid(self.slope * out + self.offset)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature, for each distinct feature of each text."""
    t = Tokens(texts, MARKS)
    return grams(t.h, t.text, BITS)


def bags(texts: list[bytes]) -> list[list[np.ndarray]]:
    """The features of each text as one bag."""
    text, found = features(texts)
    return [[x] for x in np.split(found, np.searchsorted(text, np.arange(1, len(texts))))]


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    pos, neg = np.ones(1 << BITS), np.ones(1 << BITS)
    for x, label in zip(rows, y, strict=True):
        (pos if label else neg)[x] += 1
    return np.log(pos / pos.sum()) - np.log(neg / neg.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; rows are scaled to unit length before the ratios."""
    values = [ratio[x] / max(1, len(x)) ** 0.5 for x in rows]
    sign = np.where(y == 1, 1.0, -1.0)
    weigh = np.where(y == 1, 1.0, (y == 1).sum() / max(1, (y == 0).sum())) * cost  # classes count alike
    square = np.array([v @ v for v in values]) + 1 + 1 / (2 * weigh)
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        for k in rng.permutation(len(rows)):
            x, v = rows[k], values[k]
            g = sign[k] * (w[x] @ v + bias) - 1 + alpha[k] / (2 * weigh[k])
            new = max(0.0, alpha[k] - g / square[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * sign[k]
                w[x] += step * v
                bias += step
                alpha[k] = new
    return w * ratio, bias


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, most: int = MOST) -> QualityModel:
    sample = sample_ids(labels, label, folds, held, most)
    rows, y = map_features(docs, sample, bags)
    rows = [x[0] for x in rows]
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    part, margin = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        fit = np.flatnonzero(part != k)
        if len(set(y[fit])) == 2:
            w, b = descend([rows[i] for i in fit], y[fit], log_count_ratio([rows[i] for i in fit], y[fit]))
            for i in np.flatnonzero(part == k):
                margin[i] = b + w[rows[i]].sum() / max(1, len(rows[i])) ** 0.5
    w, b = descend(rows, y, log_count_ratio(rows, y))
    return QualityModel(w, b, *platt(margin, y))


def quality_scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    return map_text(spread(docs), id_col, text_col, lambda ids, texts: {"doc_id": ids, "score": model.scores(texts)}, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scores = quality_scores(docs, train_quality(docs, labels))
    return scores.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: QualityModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least `least`; nothing is shuffled."""
    import pyarrow as pa

    at = docs.columns.index(text_col)

    def run(batches):
        kept()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield part.filter(pa.array(model.scores(as_bytes(part.column(at))) >= least))
        release()

    return spread(docs).mapInArrow(run, docs.schema)
