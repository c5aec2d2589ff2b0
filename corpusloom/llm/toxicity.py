"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its hashed
word unigrams and bigrams; a document is toxic if any sentence is, so its score is
the noisy-or 1 - prod(1 - p) of them, and the model learns from document labels
alone by gradient descent on that, over the
features whose document shares differ firmly. The sentence scores then locate what offends.

Training takes at most MOST labelled rows, as hashed features; scoring streams every
whole text once, without a shuffle.

Defined cases: null texts count as empty; a text without sentences has the lowest score, as
the noisy-or of nothing; null ids are scored with held_out null; with no toxic label
in the sample the model finds nothing toxic, with no labels neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, spread
from .labelled import MARKS, Tokens, batches_of, fold, grams, map_features, platt, sample_ids, sigmoid, sums

BITS = 18
MOST = 6_000
STEPS = 300
ENDS = b".!?\n"
INNER = MARKS & ~np.isin(np.arange(256), list(ENDS))


class ToxicityModel:
    """slope, offset: a logistic fit of labels by the logarithm of the bag's total, -log(prod(1 - p))."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def sentences(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Text number, start and end byte, and logit of each sentence with a token, about a megabyte of texts at a time."""
        for lo, part in batches_of(texts):
            t, sentence, feature, stop = features(part)
            found, total, _ = sums(self.weights, sentence, feature)
            text = np.searchsorted(t.start, stop[found], "right") - 1
            # a text's own end is the separator after it, or the buffer's end
            begin = np.append(-1, stop)[found] + 1 - t.start[text]
            yield lo + text, begin, stop[found] - t.start[text], total + self.bias

    def bag_logits(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum() for x in found]) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros(len(texts))
        for text, _, _, logit in self.sentences(texts):
            total += np.bincount(text, np.logaddexp(0, logit), len(texts))
        return sigmoid(self.slope * self.margin(total) + self.offset)

    @staticmethod
    def margin(total: np.ndarray) -> np.ndarray:
        """Logit of the noisy-or. total: -log(prod(1 - p))."""
        return np.log(np.expm1(np.clip(total, 1e-9, 30.0)))


def features(texts: list[bytes]) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' tokens; sentence number and feature, for each distinct feature of each sentence; and where sentences end."""
    t = Tokens(texts, INNER)
    sentence, stop = t.parts(ENDS)
    return t, *grams(t.h, sentence, BITS), stop


def bag(texts: list[bytes]) -> list[list[np.ndarray]]:
    """Each text's sentences, as arrays of features."""
    t, sentence, feature, stop = features(texts)
    found, first = np.unique(sentence, return_index=True)
    text = np.searchsorted(t.start, stop[found], "right") - 1
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for k, x in zip(text.tolist(), np.split(feature, first[1:]) if len(first) else [], strict=True):
        out[k].append(x)
    return out


def firm(bags: list[list[np.ndarray]], y: np.ndarray, least: float = 16.0) -> tuple[np.ndarray, np.ndarray]:
    """Features whose share of the toxic documents is firmly the larger, and the log ratios of the shares."""
    count = np.zeros((2, 1 << BITS))
    for b, label in zip(bags, y, strict=True):
        if b:
            count[label][np.unique(np.concatenate(b))] += 1
    share = (count + 0.5) / (np.array([[(y == 0).sum()], [(y == 1).sum()]]) + 1)
    ratio = np.log(share[1] / share[0])
    used = np.flatnonzero(count[1] * ratio > least)
    return used, ratio[used]


def fit(bags: list[list[np.ndarray]], y: np.ndarray, decay: float = 0.02) -> ToxicityModel:
    """Gradient descent (Adagrad, L2 penalty) on the bags' noisy-or likelihood, from the log ratios of firm features."""
    if not len(y) or not y.any():
        return ToxicityModel(np.zeros(1 << BITS), -20.0)
    used, w = firm(bags, y)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    sent = [place[x][place[x] >= 0] for b in bags for x in b]
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    col = np.concatenate([np.zeros(0, np.int64), *sent])
    row = np.repeat(np.arange(len(sent)), [len(x) for x in sent])
    bias, sq, sqb = -6.0, np.full(len(used), 1e-4), 1e-4
    for _ in range(STEPS):
        s = bias + np.bincount(row, w[col], len(sent))
        total = np.clip(np.bincount(doc, np.logaddexp(0, s), len(bags)), 1e-9, 50)
        ds = np.where(y == 1, -1 / np.expm1(total), 1.0)[doc] * sigmoid(s)
        g = np.bincount(col, ds[row], len(used)) + decay * w
        sq += g * g
        sqb += ds.sum() ** 2
        w = w - 0.5 * g / np.sqrt(sq)
        bias -= 0.5 * ds.sum() / sqb**0.5
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return ToxicityModel(weights, float(bias))


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, most: int = MOST) -> ToxicityModel:
    bags, y = map_features(docs, sample_ids(labels, label, folds, held, most), bag)
    model = fit(bags, y)
    if not len(y) or y.min() == y.max():
        return model
    part, margin = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):  # margins of documents that the fit hasn't seen
        fit_on = np.flatnonzero(part != k)
        other = fit([bags[i] for i in fit_on], y[fit_on])
        for i in np.flatnonzero(part == k):
            margin[i] = other.margin(np.logaddexp(0, other.bag_logits(bags[i])).sum())
    model.slope, model.offset = platt(margin, y)
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train_toxicity(docs, labels)

    def fn(ids, texts):
        return {"doc_id": ids, "score": model.scores(texts)}

    scores = map_text(spread(docs), "doc_id", "text", fn, "doc_id long, score double")
    return scores.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, start, stop (bytes), probability, sentence of every sentence at or above `least`.

    Null and empty texts and an empty table give no rows; null ids keep theirs; repeated rows give theirs each.
    """

    def fn(ids, texts):
        out = {"doc_id": [], "start": [], "stop": [], "probability": [], "sentence": []}
        for text, start, stop, logit in model.sentences(texts):
            for k in np.flatnonzero(sigmoid(logit) >= least).tolist():
                row = (ids[text[k]], int(start[k]), int(stop[k]), float(sigmoid(logit[k])), texts[text[k]][start[k] : stop[k]].decode("utf-8", "replace"))
                for values, x in zip(out.values(), row, strict=True):
                    values.append(x)
        return out

    return map_text(spread(docs), id_col, text_col, fn, "doc_id long, start long, stop long, probability double, sentence string")
