"""Substring dedup over bytes with a logarithmic family of suffix arrays.

Windows of `width` bytes are brought together by content-defined segments (see
``anchors``): equal segments are one class with its number of copies, and classes that
share an anchor meet in a shard. A shard takes its classes in batches. Each batch gets a
suffix array with common-prefix lengths, is merge-scanned against each level (where a
common prefix is `width` long, the window occurs twice), and becomes a level; levels of
about equal size merge into one, so there are as many levels as the number of batches
has bits. A level is two numbers a window; the windows' bytes stay in the buffer.

``suffix_dedup`` takes a table as a whole. ``SuffixFamily`` keeps levels as Parquet and scans
later batches of documents against them.

Defined cases: null texts count as empty; texts of fewer than `width` bytes lose
nothing; rows with a null id are rows like others; rows that repeat an id too, so a row
written twice loses every byte if it is long enough.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import CROWD, KEY, arrow_of, class_of, covered, find_segments, named, repeated, runs_of, texts_of, with_ranges
from .common import cut, release

WIDTH = 200
K = 32
SHARD_BYTES = 600_000
BATCH = 1 << 17


class SuffixLevels:
    """A family of suffix arrays over one buffer; `hit` marks the windows that occur twice.

    A level is a suffix array of window starts, in the order of their first `width` bytes,
    and the length of the common prefix (at most `width`) of each with the one before it.
    Of equal windows a level keeps the first.
    """

    def __init__(self, buffer: bytes, width: int = WIDTH, levels=()):
        self.width = width
        self.buffer = buffer
        b = np.frombuffer(buffer, np.uint8)
        self.windows = np.lib.stride_tricks.as_strided(b, (max(0, len(b) - width + 1), width), (1, 1), writeable=False)
        self.hit = np.zeros(len(b), bool)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = list(levels)

    def merged(self, *runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The level of the given starts; marks what is equal. Sorted runs are merged in one scan, as the stable sort takes runs as they are."""
        starts = np.concatenate(runs)
        windows = np.ascontiguousarray(self.windows[starts]).view(f"S{self.width}").ravel()
        order = np.argsort(windows, kind="stable")
        starts = starts[order]
        lcp = np.zeros(len(starts), np.uint16)
        for lo in range(1, len(starts), 1 << 14):
            x = self.windows[starts[lo - 1 : lo + (1 << 14)]]
            other = x[1:] != x[:-1]
            lcp[lo : lo + len(other)] = np.where(other.any(1), other.argmax(1), self.width)
        same = lcp >= self.width
        self.hit[starts[same | np.append(same[1:], False)]] = True
        return starts[~same], lcp[~same]

    def insert(self, starts: np.ndarray) -> None:
        """Give a batch its suffix array, merge-scan it against each level, add it as a level and merge levels of about equal size."""
        new = self.merged(starts)
        both = None
        for level in self.levels:
            both = self.merged(level[0], new[0])
        self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            self.levels[-2:] = [both or self.merged(self.levels[-2][0], self.levels[-1][0])]
            both = None


#: A window of a crowded anchor is indexed only if it has copies.
USEFUL = "not crowd or copies > 1"


def shard_ranges(width: int):
    """Runs of a class's windows that occur twice: in another class or place, or because the class has copies."""

    def run(t: pa.Table) -> pa.Table:
        key = [t.column(c).to_numpy() for c in KEY]
        _, once = np.unique(np.stack(key), axis=1, return_index=True)  # a class comes again if its row repeats id and text
        key, n, copies = [x[once] for x in key], t.column("n").to_numpy()[once], t.column("copies").to_numpy()[once]
        texts = [t.column("text")[int(k)].as_py() for k in once]
        base = np.cumsum([0, *map(len, texts)])
        index = SuffixLevels(b"".join(texts), width)
        held, windows = [], 0
        for k in range(len(texts)):
            index.hit[base[k] : base[k] + n[k]] = copies[k] > 1  # the class stands for so many texts
            held.append(np.arange(base[k], base[k] + n[k]))
            windows += int(n[k])
            if windows >= BATCH or k == len(texts) - 1:
                index.insert(np.concatenate(held))
                held, windows = [], 0
        runs = [(k, a, b) for k in range(len(texts)) for a, b in zip(*runs_of(index.hit[base[k] : base[k] + n[k]]), strict=True)]
        of, first, last = np.array(runs, np.int64).reshape(-1, 3).T
        release()
        return pa.table({**{c: pa.array(x[of]) for c, x in zip(KEY, key, strict=True)}, "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32()), "least": pa.array(np.zeros(len(of), np.int64))})

    return run


def repeated_ranges(docs: DataFrame, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """doc_id (0 for null), tid, first, last: ranges of windows (by first byte) that also start elsewhere."""
    return repeated(docs, False, width, min(K, width), True, "segments > 1 or many", USEFUL, SHARD_BYTES, shard_ranges(width), crowd).drop("least")


class SuffixFamily:
    """A family of levels kept as Parquet, to which batches of documents are added one after another.

    A level is a row a shard: the texts of its classes, one after another, their keys and sizes,
    and the suffix array of their windows with common-prefix lengths. A new batch gets its arrays
    and is merge-scanned against every level; the newest levels of about equal size are merged with
    it into one, older levels are only read. The segments of all batches stay beside the levels, to
    say which documents have a class. Anchors are dealt over `shards` for good, so choose enough for
    the corpus to come (about SHARD_BYTES of distinct segments each); crowded anchors aren't cut here.
    The list of levels is a small table, a new version a batch, written last: a batch that fails leaves the family as it was.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, width: int = WIDTH):
        self.spark, self.path, self.shards, self.width = spark, path.rstrip("/"), shards, width

    def levels(self) -> list[tuple[int, int]]:
        """(number, windows) of the levels, the oldest first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/*/_SUCCESS")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        versions = sorted(int(f.getPath().getParent().getName()) for f in found or ())
        if not versions:
            return []
        return sorted((r["number"], r["windows"]) for r in self.spark.read.schema("number int, windows long").json(f"{self.path}/versions/{versions[-1]}").collect())

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id (0 for null), tid, first, last, fresh: ranges of windows that the new batch shows to occur twice, in its own documents (fresh) and in earlier ones."""
        known, docs = self.levels(), cut(named(docs))
        number = known[-1][0] + 1 if known else 0
        rows = cut(find_segments(docs, False, self.width, min(K, self.width), True))
        rows.write.mode("overwrite").parquet(f"{self.path}/segments/batch={number}")
        whole = F.lit(1).cast("long").alias("copies"), F.col("doc_id").alias("least"), F.col("doc_id").alias("high")
        classes = class_of(rows.select(*KEY, *whole, "many", "n", F.lit(False).alias("crowd"), F.col("doc_id").alias("doc"), "tid", "s"))
        shard = F.pmod(F.xxhash64("a"), F.lit(self.shards)).cast("int")
        fresh = texts_of(classes.select(*KEY, "copies", "n", "doc", "tid", "s").withColumn("shard", shard), docs, False, self.width).select("shard", *KEY, "copies", "n", "text")
        windows = rows.agg(F.sum("n")).first()[0] or 0
        merge = []
        while known and 2 * (windows + sum(w for _, w in merge)) > known[-1][1]:
            merge.append(known.pop())
        stored = self.spark.createDataFrame([], LEVEL)
        for n, _ in known + merge[::-1]:
            stored = stored.unionByName(self.spark.read.schema(LEVEL).parquet(f"{self.path}/levels/{n}"))
        merged = {n for n, _ in merge}
        made = cut(fresh.groupBy("shard").cogroup(stored.groupBy("shard")).applyInArrow(scan_levels(self.width, number, merged), LEVEL + ", first int, last int, a long, h long, g long"))
        made.filter("a is null").drop("first", "last", "a", "h", "g").write.mode("overwrite").parquet(f"{self.path}/levels/{number}")
        state = [*known, (number, windows + sum(w for _, w in merge))]
        self.spark.createDataFrame(state, "number int, windows long").coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/{number}")
        hits = made.filter("a is not null").select(*KEY, "first", "last").distinct()
        found = self.spark.read.parquet(f"{self.path}/segments").join(hits, KEY)
        return found.select("doc_id", "tid", (F.col("s") + F.col("first")).alias("first"), (F.col("s") + F.col("last")).alias("last"), (F.col("batch") == number).alias("fresh"))


LEVEL = "shard int, level int, text binary, keys array<long>, sizes array<int>, starts array<int>, lcp array<short>"


def scan_levels(width: int, number: int, merge: set[int]):
    """For a shard: the hits of a batch's classes and of the levels, and the level that the batch and the levels to merge become."""
    arrow = arrow_of(LEVEL + ", first int, last int, a long, h long, g long")

    def run(fresh: pa.Table, stored: pa.Table) -> pa.Table:
        rows = sorted(stored.to_pylist(), key=lambda r: (r["level"] in merge, r["level"]))  # those to merge come last
        texts = [r["text"] for r in rows] + fresh.column("text").to_pylist()
        base = np.cumsum([0, *map(len, texts)])
        old = [(np.array(r["starts"], np.int64) + b, np.array(r["lcp"], np.uint16)) for r, b in zip(rows, base, strict=False)]
        index = SuffixLevels(b"".join(texts), width, old)
        first = base[len(rows)]
        size = np.array([len(t) for t in texts[len(rows) :]], np.int64)
        own = first + np.cumsum(size) - size
        if fresh.num_rows:
            for at, n, copies in zip(own.tolist(), fresh.column("n").to_pylist(), fresh.column("copies").to_pylist(), strict=True):
                index.hit[at : at + n] = copies > 1
            starts = np.concatenate([np.arange(a, a + n) for a, n in zip(own.tolist(), fresh.column("n").to_pylist(), strict=True)])
            new = index.merged(starts)
            for level in old:
                index.merged(level[0], new[0])
            joined = new if not merge else index.merged(*(o[0] for o, r in zip(old, rows, strict=True) if r["level"] in merge), new[0])
        else:
            joined = index.merged(*(o[0] for o, r in zip(old, rows, strict=True) if r["level"] in merge)) if merge else (np.zeros(0, np.int64),) * 2
        keys = [np.array(r["keys"], np.int64).reshape(-1, 3) for r in rows] + [np.stack([fresh.column(c).to_numpy() for c in KEY], 1)]
        sizes = [np.array(r["sizes"], np.int64) for r in rows] + [size]
        out = []
        for key, length, begin in zip(keys, sizes, base, strict=False):
            place = begin + np.cumsum(length) - length
            for k, (p, n) in enumerate(zip(place.tolist(), length.tolist(), strict=True)):
                for x, y in zip(*runs_of(index.hit[p : p + n - width + 1]), strict=True):
                    out.append({"first": int(x), "last": int(y), "a": int(key[k, 0]), "h": int(key[k, 1]), "g": int(key[k, 2])})
        kept = next((k for k, r in enumerate(rows) if r["level"] in merge), len(rows))  # what becomes the level is the end of the buffer
        if kept < len(keys) and sum(map(len, keys[kept:])):
            shard = fresh.column("shard")[0].as_py() if fresh.num_rows else rows[0]["shard"]
            out.append({"shard": shard, "level": number, "text": index.buffer[base[kept] :], "keys": np.concatenate(keys[kept:]).ravel().tolist(), "sizes": np.concatenate(sizes[kept:]).tolist(), "starts": (joined[0] - base[kept]).tolist(), "lcp": joined[1].tolist()})
        return pa.Table.from_pylist(out, schema=arrow)

    return run


def suffix_dedup(docs: DataFrame, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: every row without the bytes of windows that occur twice."""

    def fn(doc, raw, first, last):
        gone = covered(len(raw), width, first, last)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(first) else raw
        return doc, len(raw), int(gone.sum()), len(runs_of(gone)[0]), hashlib.sha256(kept).hexdigest()

    docs = named(docs)
    return with_ranges(docs, repeated_ranges(docs, width, crowd), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", fn)
