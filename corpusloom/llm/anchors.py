"""Content-defined segments: how the substring operators bring equal windows together.

The smallest hash among a window's k-grams depends on the window's content alone, so
equal windows have equal anchors. A run of neighbouring windows with one anchor is a
segment; a document of n units has about 2 n / (width - k + 2) of them. An anchor that
occurs once can't be in a repeated window: its segments go no further.

Segments with the same anchor and the same text (128 bits of xxh3 over the whole text of
the segment) form a class: a row with its number of copies and least and largest
document, counted before the shuffle. Classes go to the operator's index, a shard a range
of anchors, and what the index reports for a class holds for each of its copies.

An anchor with more than CROWD segments (a passage that very many documents share in
different contexts) would fill a shard. Its classes are cut into single windows, each
keyed by its own content, so equal windows are again a class, and what differs is spread
over all shards. So a shard holds about its set size, plus a crowd at most.

Rows are named by id and text hash, so rows that repeat an id stay apart; null ids are
told apart from all others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, discard, powers, spread, word_spans

MIX = np.uint64(0xBF58476D1CE4E5B9)
NOT_SPACE = np.array([bytes([b]).strip() != b"" for b in range(256)])
PIECE = 1 << 19  # units of a document that are windowed at a time
LONGEST = 256  # windows of a segment
FEW_IDS = 1 << 20  # ids that are broadcast (8 MB); more of them aren't used to filter documents
CROWD = 2000  # segments of an anchor, beyond which it is cut into windows
SEGMENTS = "a long, h long, g long, doc_id long, tid long, s int, n int, many boolean"
KEY = ["a", "h", "g"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x)
    y = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


class Units:
    """A text as numbered units, words (joined by one space) or bytes, with a number for each.

    Equal units have equal numbers. The converse isn't asked for: numbers only choose
    anchors, and whether two segments are equal is told by `digest`, from the text itself.
    """

    def __init__(self, raw: bytes, words: bool):
        self.words, self.raw = words, b" ".join(raw.split()) if words else raw
        if words:
            self.first, self.end, self.x = word_spans(self.raw, NOT_SPACE)
        else:
            self.x = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)

    def part(self, s: int, n: int) -> bytes:
        """The text of n units from the s-th on."""
        return self.raw[self.first[s] : self.end[s + n - 1]] if self.words else self.raw[s : s + n]


def digests(parts) -> np.ndarray:
    """Two signed 64-bit numbers a part: its 128-bit xxh3."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(p) for p in parts]), "<i8").reshape(-1, 2)


def segments(x: np.ndarray, bounds: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows, anchor, and whether the anchor recurs, of each segment.

    x: units of texts one after another; bounds: where each begins, and the end.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    n = len(x) - width + 1
    if n <= 0:
        return empty
    up, down = powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=total[1:])
    g = mixed((total[k:] - total[:-k]) * down[: len(x) - k + 1])
    places = np.arange(len(g), dtype=np.uint64)
    at = (sliding_min((g & ~np.uint64(0xFFFFFF)) | places, width - k + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    anchor = g[at]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    valid = np.arange(n) + width <= bounds[1:][text]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return empty
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    # a run is longer than width - k + 1 only if its anchor recurs in it; such a run is cut into pieces
    size = -(-(stop - first) // LONGEST)
    piece = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    first, stop, many = (np.repeat(x, size) for x in (first, stop, at[first] != at[stop - 1]))
    first = first + piece * LONGEST
    return text[first], first - bounds[text[first]], np.minimum(stop - first, LONGEST), anchor[first], many


def row_name(doc: int | None, raw: bytes) -> tuple[int, int]:
    """doc_id (0 for none) and text hash, which is another for a null id than for any id."""
    return doc or 0, xxhash.xxh3_64_intdigest(raw, doc is None) - (1 << 63)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text as a string: what the substring operators read."""
    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def find_segments(docs: DataFrame, words: bool, width: int, k: int, nulls: bool, piece: int = PIECE) -> DataFrame:
    """The segments of every text of at least `width` units; rows with a null id have some only if `nulls`."""

    def batch(pieces):
        """pieces: row name, first unit, number of units, units."""
        bounds = np.cumsum([0, *(p[2] for p in pieces)])
        text, s, n, a, many = segments(np.concatenate([p[3].x[p[1] : p[1] + p[2]] for p in pieces]), bounds, width, k)
        s = s + np.array([p[1] for p in pieces], np.int64)[text]
        h = digests(pieces[t][3].part(i, m + width - 1) for t, i, m in zip(text.tolist(), s.tolist(), n.tolist(), strict=True))
        name = np.array([p[0] for p in pieces], np.int64)[text]
        return pa.record_batch({
            "a": pa.array(a.view(np.int64)), "h": pa.array(h[:, 0]), "g": pa.array(h[:, 1]), "doc_id": pa.array(name[:, 0]), "tid": pa.array(name[:, 1]),
            "s": pa.array(s.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "many": pa.array(many),
        })

    def run(batches):
        held, size = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for doc, raw in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                    if len(raw) < width or doc is None and not nulls:
                        continue
                    u, name = Units(raw, words), row_name(doc, raw)
                    if len(u.x) > piece:  # windows of a long text in pieces that overlap by a window
                        for s in range(0, max(1, len(u.x) - width + 1), piece):
                            yield batch([(name, s, min(piece + width - 1, len(u.x) - s), u)])
                        continue
                    held.append((name, 0, len(u.x), u))
                    size += len(raw)
                    if size > 1 << 17:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    return docs.mapInArrow(run, SEGMENTS)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id (the row's), at (its name's id), tid, z: texts compressed before they are shuffled."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                raw = as_bytes(part.column(1))
                names = [row_name(d, x) for d, x in zip(part.column(0).to_pylist(), raw, strict=True)]
                yield pa.record_batch({"doc_id": part.column(0), "at": pa.array([x[0] for x in names], pa.int64()), "tid": pa.array([x[1] for x in names], pa.int64()), "z": pa.array([z.compress(x) for x in raw], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, at long, tid long, z binary")


def unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def arrow_of(shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(shape))


def texts_of(wanted: DataFrame, docs: DataFrame, words: bool, width: int) -> DataFrame:
    """wanted (doc, tid, s, n, ...: a row with each segment's text): one join by document row."""
    fields = [c for c in wanted.columns if c not in ("doc", "tid")]
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    grouped = wanted.groupBy("doc", "tid").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    shape = ", ".join(f"{c} {kinds[c]}" for c in fields) + ", text binary"
    arrow = arrow_of(shape)

    def run(batches):
        last = None
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                rows = []
                for r in b.slice(lo, 64).to_pylist():
                    if (r["at"], r["tid"]) == last:  # a row that repeats id and text
                        continue
                    last, u = (r["at"], r["tid"]), Units(unpacked(r["z"]), words)
                    rows += [p | {"text": u.part(p["s"], p["n"] + width - 1)} for p in r["parts"]]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    grouped = grouped.withColumnRenamed("doc", "at")
    return grouped.join(packed(docs).drop("doc_id"), ["at", "tid"]).select("at", "tid", "z", "parts").mapInArrow(run, shape)


def with_ranges(docs: DataFrame, ranges: DataFrame, shape: str, fn: Callable[[int, bytes, np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """fn(doc_id, text, first, last: ranges of windows) for every document row, those without ranges too."""
    grouped = ranges.groupBy(F.col("doc_id").alias("at"), "tid").agg(F.collect_list(F.struct(F.col("first").cast("int"), F.col("last").cast("int"))).alias("ranges"))
    names = [c.split()[0] for c in shape.split(", ")]
    arrow = arrow_of(shape)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                listed = part.column("ranges")
                flat = listed.flatten()
                first, last = (flat.field(k).to_numpy() for k in (0, 1))
                ends = np.cumsum(listed.value_lengths().fill_null(0).to_numpy())
                rows = [fn(doc, unpacked(z.as_py()), first[a:e], last[a:e]) for doc, z, a, e in zip(part.column("doc_id").to_pylist(), part.column("z"), np.append(0, ends), ends, strict=False)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)

    return packed(docs).join(grouped, ["at", "tid"], "left").select("doc_id", "z", "ranges").mapInArrow(run, shape)


def covered(n: int, width: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n units lie in a window that begins in one of the ranges."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(last + width, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).view(np.int8)))
    return edge[0::2], edge[1::2] - 1


def class_of(rows: DataFrame) -> DataFrame:
    """a, h, g, copies, least, high, many, n, and one segment (doc, tid, s), of segments with equal anchor and text."""
    least = rows.groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.min("least").alias("least"), F.max("high").alias("high"), F.max("many").alias("many"), F.max("n").alias("n"), F.max("crowd").alias("crowd"), F.min(F.struct("doc", "tid", "s")).alias("one"))
    return least.select(*KEY, "copies", "least", "high", "many", "n", "crowd", "one.doc", "one.tid", "one.s")


def windows_of(classes: DataFrame, docs: DataFrame, words: bool, width: int) -> DataFrame:
    """The classes' windows, keyed by their content: w (number in the class), a, h, g, and the class as ca, ch, cg."""
    ids = classes.select("doc").distinct()
    if ids.count() <= FEW_IDS:  # only the documents that stand for a class are shuffled then
        docs = docs.join(F.broadcast(ids), F.coalesce("doc_id", F.lit(0)) == F.col("doc"), "left_semi")
    wanted = classes.select(F.col("a").alias("ca"), F.col("h").alias("ch"), F.col("g").alias("cg"), "copies", "least", "high", "n", "doc", "tid", "s", F.col("doc").alias("of_doc"), F.col("tid").alias("of_tid"))
    shape = "ca long, ch long, cg long, w int, a long, h long, g long, copies long, least long, high long, many boolean, n int, crowd boolean, doc long, tid long, s int"
    arrow = arrow_of(shape)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                u = Units(r["text"], words)
                for w, (h, g) in enumerate(digests(u.part(i, width) for i in range(r["n"])).tolist()):
                    rows.append({"ca": r["ca"], "ch": r["ch"], "cg": r["cg"], "w": w, "a": h, "h": h, "g": g, "copies": r["copies"], "least": r["least"], "high": r["high"], "many": False, "n": 1, "crowd": True, "doc": r["of_doc"], "tid": r["of_tid"], "s": r["s"] + w})
                if len(rows) > 1 << 14:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return texts_of(wanted, docs, words, width).mapInArrow(run, shape)


def repeated(docs: DataFrame, words: bool, width: int, k: int, nulls: bool, shared: str, useful: str, shard_size: int, index: Callable[[pa.Table], pa.Table], crowd: int = CROWD) -> DataFrame:
    """doc_id, tid, first, last, least: ranges of windows that the index reports for document rows.

    shared: whether an anchor can be in a repeated window, over segments (how many it has), low
    and high (least and largest document) and many (a segment's windows can repeat each other).
    useful: whether a class is worth indexing, over copies, least, high, many and crowd (it is a
    window of a crowded anchor). index: takes a shard's table (a, h, g, copies, least,
    high, n, text) and gives a, h, g, first, last, least: ranges of windows of a class, from 0 on.
    """
    found = cut(find_segments(docs, words, width, k, nulls))
    # only what `shared` reads is aggregated, as Catalyst prunes the rest
    facts = found.groupBy("a").agg(F.count("*").alias("segments"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("many").alias("many"))
    anchors = facts.filter(shared).select("a", "segments")
    rows = cut(found.join(anchors, "a").select(*KEY, "doc_id", "tid", "s", "n", "many", (F.col("segments") > crowd).alias("crowd")))
    discard(found)
    first = class_of(rows.select(*KEY, F.lit(1).cast("long").alias("copies"), F.col("doc_id").alias("least"), F.col("doc_id").alias("high"), "many", "n", "crowd", F.col("doc_id").alias("doc"), "tid", "s"))
    classes = cut(first)
    wanted = classes.filter(~F.col("crowd") & F.expr(useful))
    crowded = classes.filter("crowd")
    crowds = not crowded.isEmpty()
    if crowds:
        windows = cut(windows_of(crowded, docs, words, width))
        wanted = wanted.unionByName(class_of(windows.drop("ca", "ch", "cg", "w")).filter(F.expr(useful)))
    wanted = wanted.select(*KEY, "copies", "least", "high", "n", "doc", "tid", "s")
    total = wanted.agg(F.sum(F.col("n") + F.lit(width - 1))).first()[0] or 0
    shards = max(1, -(-total // shard_size))
    texts = texts_of(wanted.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))), docs, words, width)
    told = cut(texts.groupBy("shard").applyInArrow(index, "a long, h long, g long, first int, last int, least long"))
    discard(classes)
    if crowds:  # what is told of a window holds for that window of its classes
        back = windows.select(*KEY, "ca", "ch", "cg", "w").join(told.select(*KEY, F.col("least").alias("low")), KEY).select(F.col("ca").alias("a"), F.col("ch").alias("h"), F.col("cg").alias("g"), "w", "low")
        neighbours = Window.partitionBy(*KEY, "low").orderBy("w")
        back = back.withColumn("run", F.col("w") - F.row_number().over(neighbours))  # the same for each of a run
        told = told.unionByName(back.groupBy(*KEY, F.col("low").alias("least"), "run").agg(F.min("w").alias("first"), F.max("w").alias("last")).drop("run"))
    parts = told.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "least")).alias("parts"))  # n at most
    joined = rows.join(parts, KEY).select("doc_id", "tid", "s", F.explode("parts").alias("p"))
    return joined.select("doc_id", "tid", (F.col("s") + F.col("p.first")).alias("first"), (F.col("s") + F.col("p.last")).alias("last"), "p.least")
