"""Bounded training samples, folds and hashed word n-grams for the trained operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, kept, release, word_spans

BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words (letters, digits, the underscore, whatever isn't ASCII), and marks: neither that nor white space.
WORD = np.array([bytes([b]).isalnum() or b == 95 or b > 127 for b in range(256)])
MARKS = np.array([not WORD[b] and bytes([b]).strip() != b"" for b in range(256)])


def fold(id_col, folds: int):
    """crc32 of the id as text, modulo folds (null for a null id)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def least_hashed(rows: DataFrame, hashed, tie: str, most: int, bits: int = 12) -> DataFrame:
    """The `most` rows with the least hashes, without each task sending its own `most` to one.

    Rows are counted by the hash's first bits (at most 2^bits counts come to the driver),
    and only those up to the bound where the counts reach `most` are sorted.
    """
    bucket = F.shiftright(hashed, 64 - bits)
    counts, total, bound = rows.groupBy(bucket.alias("b")).count().collect(), 0, None
    for r in sorted(counts):
        total += r["count"]
        if total >= most:
            bound = r["b"]
            break
    kept = rows if bound is None else rows.filter(bucket <= bound)
    return kept.orderBy(hashed, tie).limit(most)


def sample_ids(labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """id, y: at most `most` labelled rows outside the held-out fold, picked by a hash of the id.

    Rows with a null id or label are left out; of contradicting labels the larger counts.
    """
    rows = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).dropna()
    rows = rows.filter(fold(F.col("id"), folds) != held).groupBy("id").agg(F.max("y").alias("y"))
    return least_hashed(rows, F.xxhash64("id"), "id", most)


class Tokens:
    """The tokens of several texts, found and hashed at once: runs of word bytes and, if asked for, runs of other marks.

    Texts are lowered (A-Z) and joined by a line feed, which no token holds. start: where each
    text begins in the joined buffer; first, end, h: place and hash of each token; text: its text.
    """

    def __init__(self, texts: list[bytes], marks: np.ndarray | None):
        self.buffer = b"\n".join(texts).lower()
        self.start = np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
        spans = word_spans(self.buffer, WORD)
        if marks is not None:
            other = word_spans(self.buffer, marks)
            order = np.argsort(np.concatenate([spans[0], other[0]]), kind="stable")
            spans = tuple(np.concatenate(x)[order] for x in zip(spans, other, strict=True))
        self.first, self.end, self.h = spans
        self.text = np.searchsorted(self.start, self.first, "right") - 1

    def parts(self, ends: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each token the number of the part that it lies in, where any of the bytes `ends` (and a text's end) ends a part; and where the parts end."""
        stop = np.flatnonzero(np.isin(np.frombuffer(self.buffer, np.uint8), np.frombuffer(ends, np.uint8)))
        return np.searchsorted(stop, self.first), np.append(stop, len(self.buffer))


def grams(h: np.ndarray, bag: np.ndarray, bits: int, repeats: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bag and hash, without repeats and in order, of the words and word pairs of each bag. h, bag: of each token; bags are in order.

    repeats: also whether a bag has a word twice in a row, and whether over a quarter of its words are such.
    """
    mask = np.uint64((1 << bits) - 1)
    same = bag[1:] == bag[:-1]
    mix = lambda x: (x ^ (x >> np.uint64(32))) * _MIX >> np.uint64(64 - bits)
    pair = ((h[:-1] ^ (h[:-1] >> np.uint64(31))) * _MIX + h[1:])[same]
    bags, found = [bag, bag[1:][same]], [mix(h), mix(pair)]
    if repeats:
        twice = bag[1:][same & (h[1:] == h[:-1])]
        which, n = np.unique(twice, return_counts=True)
        mostly = which[n * 4 > np.searchsorted(bag, which, "right") - np.searchsorted(bag, which)]
        bags += [which, mostly]
        found += [np.full(len(which), 1, np.uint64), np.full(len(mostly), 2, np.uint64)]
    key = np.unique(np.concatenate(bags).astype(np.uint64) << np.uint64(bits) | np.concatenate(found))
    return (key >> np.uint64(bits)).astype(np.int64), (key & mask).astype(np.int64)


def sums(weights: np.ndarray, bag: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bags that have features, the sum of their features' weights, and how many they have. bag: in order."""
    if not len(bag):
        return np.zeros(0, np.int64), np.zeros((0, *weights.shape[1:])), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
    return bag[first], np.add.reduceat(weights[feature], first, axis=0), np.diff(np.append(first, len(bag)))


def batches_of(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in runs of about `most` bytes (a longer text is a run), each with the number of its first."""
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= most:
            size, hi = size + len(texts[hi]), hi + 1
        yield lo, texts[lo:hi]
        lo = hi


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of y by the margin (Newton steps, smoothed targets)."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def map_features(docs: DataFrame, sample: DataFrame, features) -> tuple[list, np.ndarray]:
    """The sampled documents' hashed features (made on the executors) and labels, in a fixed order.

    features gives, for a list of texts, each one's list of arrays: one a sentence (or one in all).
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), "id")  # as many rows as the sample's bound

    def run(batches):
        kept()
        for b in batches:
            made = [[x.tolist() for x in bags] for _, part in batches_of(as_bytes(b.column(1))) for bags in features(part)]
            yield pa.record_batch({"id": b.column(0), "y": b.column(2), "x": pa.array(made, pa.list_(pa.list_(pa.int32())))})
            del made
        release()

    found = rows.mapInArrow(run, "id long, y int, x array<array<int>>").toArrow().sort_by("id")
    x = []
    for chunk in found.column("x").chunks:  # views of the Arrow buffers, not Python numbers
        for doc in chunk:
            inner = doc.values
            flat, ends = inner.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(inner).to_pylist()])
            x.append([flat[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)])
    return x, found.column("y").to_numpy()
