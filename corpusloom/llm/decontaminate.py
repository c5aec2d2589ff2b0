"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document leaks an item of L words if one of its windows, of any length, is within
floor(0.2 L) word edits of the item (similarity 0.8 or more; words are runs of
letters, digits and underscores in lower case, so case and punctuation don't count).

A sound filter says where to look: an item cut into floor(0.2 L) + 1 pieces keeps a piece
intact under that many edits, so only the stretch of L words and the budget on either side,
laid around an intact piece, can match, and only if L + budget words of it hold enough of
the item's. Every window of L words of a stretch is embedded by CGK's random walk (a symbol's
random bit says whether the walk moves on), which turns edit distance into Hamming distance.
TABLES walks are read at SAMPLED places each, among the first REACH * L steps, where a walk
hasn't ended yet. What is read is the key of a bucket; the items of L words in the buckets of
a stretch's windows are its candidates. A test measures the tables' recall (over 0.99 for
passages at the edge of the budget) and how many unrelated stretches find an item in them
(under 0.1). The edit distance of the best window of each candidate's stretch is then computed
exactly, with both ends free where asked for (Myers' bit-parallel rows).

The items are the query set: blocks of BLOCK of them come to the driver in turn and
go with the code to the tasks; documents are streamed once a block and never shuffled.

Defined cases: null or wordless items and texts match nothing; items of fewer than 5
words match exactly; of equal items each is reported; null ids are kept in the rows.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, spread, word_spans

SHARE = 5  # an edit for each so many words
TABLES = 48
SAMPLED = 3
REACH = 1.25
BLOCK = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")
INSIDE = np.array([bool(_WORD.match(bytes([b]))) for b in range(256)])


def words(raw: bytes) -> list[bytes]:
    return _WORD.findall(raw.decode("utf-8", "replace").lower().encode())


def distances(masks: dict[bytes, int], size: int, window: list[bytes], free: bool) -> list[int]:
    """Edit distance of an item (masks: bits of each word's places in it) to the words up to each place: from the first word, or, if free, from whichever is best."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, out = full, 0, size, []
    for w in window:
        eq = masks.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diag | up)), up & diag
        score += bool(right & top) - bool(left & top)
        out.append(score)
        right = (right << 1) | (not free)
        up = ((left << 1) | (full & ~(diag | right))) & full
        down = right & diag & full
    return out


def bits(ws: list[bytes]) -> dict[bytes, int]:
    mask: dict[bytes, int] = defaultdict(int)
    for k, w in enumerate(ws):
        mask[w] |= 1 << k
    return dict(mask)


class Items:
    """A block of benchmark items, prepared for the scan."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int = 11, free_ends: bool = True):
        self.free_ends = free_ends
        rng = np.random.default_rng(seed)
        self.items = [(i, w) for i, t in rows if (w := words((t or "").encode()))]
        most = int(REACH * max([1, *(len(w) for _, w in self.items)])) + 1
        self.turn = rng.integers(1, 1 << 63, (TABLES, most), dtype=np.uint64) | np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, (TABLES, most), dtype=np.uint64)
        self.place = rng.random((TABLES, SAMPLED))
        vocabulary = sorted({w for _, ws in self.items for w in ws})
        self.hashes = np.sort(np.concatenate([np.zeros(0, np.uint64), *(word_spans(w, INSIDE)[2] for w in vocabulary)]))
        coded = [np.searchsorted(self.hashes, word_spans(b" ".join(ws), INSIDE)[2]).astype(np.uint64) + np.uint64(1) for _, ws in self.items]
        self.own = [np.unique(c) for c in coded]
        self.masks = [(bits(ws), bits(ws[::-1])) for _, ws in self.items]
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (_, ws) in enumerate(self.items):
            budget = len(ws) // SHARE
            size = len(ws) // (budget + 1)
            keys = self.keys(coded[n], size)[1]
            for k in range(budget + 1):
                pieces[size][int(keys[k * size])].append((n, k * size))
        self.pieces = {s: (np.array(sorted(p), np.uint64), dict(p)) for s, p in pieces.items()}
        self.buckets: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: keys in order, and the items they belong to
        for size in sorted({len(ws) for _, ws in self.items}):
            which = np.array([n for n, (_, ws) in enumerate(self.items) if len(ws) == size])
            h = np.concatenate([word_spans(b" ".join(self.items[n][1]), INSIDE)[2] for n in which])
            first = np.arange(len(which)) * size
            keys = self.embed(h, first, first + size, size).ravel()
            order = np.argsort(keys, kind="stable")
            self.buckets[size] = keys[order], np.repeat(which, TABLES)[order]

    @staticmethod
    def keys(coded: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where `size` known words (not 0) begin, and a key for them."""
        n = len(coded) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        known = coded > 0
        at = np.flatnonzero(np.logical_and.reduce([known[k : k + n] for k in range(size)]))
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            out = out * MIX + coded[at + k]
        return at, out

    def embed(self, h: np.ndarray, first: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        """Bucket keys (a row's by table) of the windows of `size` words that begin at `first`: what their CGK walks read at the sampled places. h: words' hashes; words from `end` on are blank."""
        at = first[:, None] + np.arange(size + 1)
        x = np.where((at < end[:, None]) & (np.arange(size + 1) < size), h[np.minimum(at, len(h) - 1)], np.uint64(0))
        at, row = np.zeros((len(x), TABLES), np.int64), np.arange(len(x))[:, None]
        out = np.tile(np.arange(1, TABLES + 1, dtype=np.uint64), (len(x), 1))
        place = (self.place * REACH * size).astype(np.int64)
        for j in range(int(place.max()) + 1):
            s = x[row, at]
            read = (place == j).any(1)
            out[:, read] = (out[:, read] ^ (out[:, read] >> np.uint64(31))) * MIX + s[:, read] + np.uint64(1)
            turn = ((s * self.turn[:, j] + self.shift[:, j]) >> np.uint64(63)).astype(np.int64)
            at = np.minimum(at + turn, size)  # the walk stays on the blank after the end
        return out

    def candidates(self, h: np.ndarray, spans: np.ndarray, size: int) -> set[tuple[int, int]]:
        """(number of the stretch, item) of the items of `size` words that share a bucket with a window of the stretch. spans: first word and end of each."""
        windows = np.maximum(1, spans[:, 1] - spans[:, 0] - size + 1)
        of = np.repeat(np.arange(len(spans)), windows)
        first = spans[of, 0] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        known, item = self.buckets[size]
        out: set[tuple[int, int]] = set()
        for lo in range(0, len(of), 1 << 13):
            keys = self.embed(h, first[lo : lo + (1 << 13)], spans[of[lo : lo + (1 << 13)], 1], size)
            a, b = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
            for w, t in zip(*np.nonzero(b > a), strict=True):
                out.update((int(of[lo + w]), int(n)) for n in item[a[w, t] : b[w, t]])
        return out

    def stretches(self, coded: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(text, item, first word, end) of each stretch around an intact piece that has enough of the item's words.

        bounds: the first word of each text, and the number of words.
        """
        out: set[tuple[int, int, int, int]] = set()
        for size, (known, where) in self.pieces.items():
            at, keys = self.keys(coded, size)
            if not len(keys):
                continue
            slot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            for k in np.flatnonzero(known[slot] == keys):
                text = int(np.searchsorted(bounds, at[k], "right")) - 1
                for n, offset in where[int(keys[k])]:
                    length = len(self.items[n][1])
                    budget = length // SHARE
                    first = max(int(bounds[text]), int(at[k]) - offset - budget)
                    end = min(int(bounds[text + 1]), int(at[k]) - offset + length + budget)
                    shared = np.concatenate([[0], np.cumsum(np.isin(coded[first:end], self.own[n]))])
                    wide = min(length + budget, end - first)
                    if (shared[wide:] - shared[: len(shared) - wide]).max() >= length - budget:
                        out.add((text, n, first, end))
        return out

    def best_window(self, n: int, ws: list[bytes]) -> tuple[int, int]:
        """The least edit distance of the item to a window of ws, and the first word of the earliest such window."""
        (masks, back), size = self.masks[n], len(self.items[n][1])
        if not self.free_ends:
            return min(((distances(masks, size, ws[k : k + size], False)[-1], k) for k in range(len(ws) - size + 1)), default=(size, 0))
        to = distances(masks, size, ws, True)
        end = int(np.argmin(to))
        from_ = distances(back, size, ws[end::-1], False)
        return to[end], end - max(k for k, d in enumerate(from_) if d == to[end]) if to[end] < size else 0

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """Text's index, item id, first word, edit distance and item length of the best window of each leaked item."""
        if not self.items:
            return []
        parts = [raw.decode("utf-8", "replace").lower().encode() for raw in texts]
        low = b"\n".join(parts)
        first, end, h = word_spans(low, INSIDE)
        bounds = np.append(np.searchsorted(first, np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])), len(first))
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = self.stretches(np.where(self.hashes[slot] == h, slot + 1, 0).astype(np.uint64), bounds)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for size in self.buckets:
            spans = sorted({(lo, hi, k) for k, n, lo, hi in found if len(self.items[n][1]) == size})
            if not spans:
                continue
            for place, n in sorted(self.candidates(h, np.array(spans)[:, :2], size)):
                lo, hi, k = spans[place]
                d, s = self.best_window(n, [low[a:b] for a, b in zip(first[lo:hi], end[lo:hi], strict=True)])
                if d <= size // SHARE:
                    best[k, n] = min(best.get((k, n), (d, lo + s)), (d, lo + s))
        return [(k, self.items[n][0], s - int(bounds[k]), d, len(self.items[n][1])) for (k, n), (d, s) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", free_ends: bool = False) -> DataFrame:
    """doc_id, item_id, first_word, edits, item_words: the best window of each leaked item, a row for each document and item.

    free_ends: windows may have any length (the query and the pipeline ask for this); else the item's length alone.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = max(1, -(-items.count() // BLOCK))
    found = None
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        block = Items(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r)), free_ends=free_ends)

        def fn(ids, texts, block=block):
            out, lo = [], 0
            while lo < len(texts):  # about a megabyte at a time
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size < 1 << 20:
                    size, hi = size + len(texts[hi]), hi + 1
                out += [(ids[lo + k], *leak) for k, *leak in block.leaks(texts[lo:hi])]
                lo = hi
            cols = list(zip(*out, strict=True)) or [()] * 5
            return dict(zip(("doc_id", "item_id", "first_word", "edits", "item_words"), map(list, cols), strict=True))

        part = map_text(spread(docs), id_col, text_col, fn, "doc_id long, item_id long, first_word long, edits int, item_words int")
        found = part if found is None else found.unionByName(part)
    return found
