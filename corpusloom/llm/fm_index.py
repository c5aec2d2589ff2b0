"""Substring dedup over words with a compressed FM-index per shard.

Windows of `width` words are brought together by content-defined segments (see
``anchors``): equal segments are one class with its smallest document, and classes that
share an anchor meet in a shard. A shard compiles its classes into an FM-index: the
Burrows-Wheeler transform as a wavelet matrix of packed bit planes with rank counts,
plus the bounds and the smallest document of each class of suffixes that agree in `width`
words. The shard's texts are streamed against it by backward search, all in step: each
word to the left is one step (two ranks a bit plane), and when the match is `width` long
its last word is dropped by widening the interval to the class of width - 1. The
matching statistics reach the threshold where the interval holds a window; it is
reported with the interval's smallest document, and removed from larger ones.

Defined cases: null texts and texts of fewer than `width` words lose nothing; rows
with a null id neither lose words nor cause losses; rows that repeat an id (with the
same text or another) don't count against each other, as no id is smaller.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .anchors import CROWD, KEY, covered, named, repeated, with_ranges
from .common import release

WIDTH = 50
K = 10
SHARD_WORDS = 250_000


class WaveletMatrix:
    """Rank over a sequence of small integers, in packed bit planes."""

    def __init__(self, x: np.ndarray, symbols: int):
        self.planes: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        y = x
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            b = (y >> bit) & 1
            packed = np.packbits(np.append(b, np.zeros(-len(b) % 64 + 64, b.dtype)).astype(np.uint8), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.uint32)
            zeros = len(b) - int(b.sum())
            self.planes.append((bit, packed, before, zeros))
            y = np.concatenate([y[b == 0], y[b == 1]])
        self.begin = np.zeros(symbols, np.int64)  # where each symbol's block begins in the last plane
        values, first = np.unique(y, return_index=True)
        self.begin[values] = first

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] stands before place i[k]."""
        for bit, packed, before, zeros in self.planes:
            word = i >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            ones = ones.astype(np.int64)
            i = np.where((c >> bit) & 1 == 1, zeros + ones, i - ones)
        return i - self.begin[c]


def suffix_ranks(x: np.ndarray, length: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Order of the suffixes by their first `length` (a power of two) symbols, and ranks by each power below."""
    ranks, rank, size = {}, x.astype(np.int64), 1
    order = np.argsort(rank)
    while True:
        ranks[size] = rank
        if size >= length:
            return order, ranks
        after = np.zeros(len(x), np.int64)
        after[: len(x) - size] = rank[size:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(len(x), np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        size *= 2


class FmIndex:
    """Index of texts (symbols 1 .. symbols-1, one text after another, of the given sizes) with an id each; 0 ends a text."""

    def __init__(self, flat: np.ndarray, size: np.ndarray, ids: np.ndarray, symbols: int, width: int = WIDTH):
        self.width = width
        x = np.insert(flat, np.cumsum(size), 0)
        owner = np.repeat(ids, size + 1)
        half = 1 << ((width - 1).bit_length() - 1)  # half < width <= 2 * half
        order, ranks = suffix_ranks(x, 2 * half)
        self.wavelet = WaveletMatrix(x[order - 1], symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=symbols))])

        def new(length):  # where a class of suffixes that agree in `length` symbols begins, in order
            far = np.minimum(order + length - half, len(x) - 1)
            a, b = ranks[half][order], ranks[half][far]
            return np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))

        wide = new(width - 1)
        begin = np.flatnonzero(wide)
        number = np.cumsum(wide) - 1
        self.wide_first, self.wide_end = begin[number], np.append(begin[1:], len(x))[number]
        exact = new(width)
        self.exact_least = np.minimum.reduceat(owner[order], np.flatnonzero(exact))[np.cumsum(exact) - 1]

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the pattern with c put before it."""
        return self.less[c] + self.wavelet.rank(c, lo), self.less[c] + self.wavelet.rank(c, hi)

    def least_ids(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each place of indexed texts (one after another, of the given sizes), the least id of a text with the window that begins there. Texts are streamed in step, right to left."""
        first = np.cumsum(size) - size
        total = np.zeros(len(flat), np.int64)
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), len(self.wide_first), np.int64)
        for t in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > t)
            place = first[live] + size[live] - 1 - t
            a, b = lo[live], hi[live]
            if t >= self.width:
                a, b = self.wide_first[a], self.wide_end[a]
            a, b = self.step(flat[place], a, b)
            lo[live], hi[live] = a, b
            if t >= self.width - 1:
                total[place] = self.exact_least[a]
        return total


#: A window of a crowded anchor is indexed only if documents share it.
USEFUL = "not crowd or least < high"


def shard_ranges(width: int):
    """What the shard's index reports: runs of a class's windows with the least document that has them, where that is below the class's largest."""

    def run(t: pa.Table) -> pa.Table:
        key = [t.column(c).to_numpy() for c in KEY]
        _, once = np.unique(np.stack(key), axis=1, return_index=True)  # a class comes again if its row repeats id and text
        key, least, high = [x[once] for x in key], t.column("least").to_numpy()[once], t.column("high").to_numpy()[once]
        words = pc.split_pattern(t.column("text").combine_chunks().take(pa.array(once)), b" ")
        flat = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        size = pc.list_value_length(words).to_numpy().astype(np.int64)
        low = FmIndex(flat, size, least, int(flat.max(initial=0)) + 1, width).least_ids(flat, size)
        text = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.flatnonzero((place <= size[text] - width) & (low < high[text]))
        text, place, low = text[hit], place[hit], low[hit]
        new = np.append(True, (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1) | (low[1:] != low[:-1]))[: len(hit)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit))[: len(first)] - 1
        release()
        return pa.table({**{c: pa.array(x[text[first]]) for c, x in zip(KEY, key, strict=True)}, "first": pa.array(place[first], pa.int32()), "last": pa.array(place[last], pa.int32()), "least": pa.array(low[first])})

    return run


def repeated_ranges(docs: DataFrame, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, tid, first, last: ranges of windows (by first word) that also start in a smaller document."""
    found = repeated(docs, True, width, min(K, width), False, "low < high", USEFUL, SHARD_WORDS, shard_ranges(width), crowd)
    return found.filter("least < doc_id").drop("least")


def substring_dedup(docs: DataFrame, width: int = WIDTH, kept_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text): every row without the words of windows that a smaller document has."""

    def fn(doc, raw, first, last):
        words = raw.split()
        gone = covered(len(words), width, first, last)
        kept = b" ".join(words if not len(first) else [w for w, g in zip(words, gone, strict=True) if not g])
        row = (doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        return row + (kept.decode("utf-8", "replace"),) if kept_text else row

    docs = named(docs)
    return with_ranges(docs, repeated_ranges(docs, width, crowd), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * kept_text, fn)
