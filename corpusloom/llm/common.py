"""What the operators of this subpackage share: scratch tables, text batches, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java/RE2 character class; bytes.split() cuts at the same characters.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. Where it is unset, a local run (and so a test) gets a
    temporary folder; on a cluster that is an error, as executors don't see the driver's folders.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back.

    Ends the lineage like checkpoint(), survives lost executors, and, unlike an
    eager checkpoint, computes the plan once and stores it in columns.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no unfinished result reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """remove(), and ask the driver for a garbage collection, which is when Spark drops the shuffle files of plans that are done; else they lie on the executors' disks for half an hour."""
    remove(*tables)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()
    release()


def release() -> None:
    """Give freed memory back to the system: workers are kept after a task, and with them what their allocators hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_KEPT: dict[str, dict] = {}


def kept(owner: str = "") -> dict:
    """What a worker keeps between its tasks for one operator. Workers outlive a query: what they kept for another operator is given back first."""
    if owner not in _KEPT:
        _KEPT.clear()
        gc.collect()
        release()
        _KEPT[owner] = {}
    return _KEPT[owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least two tasks a core: a table in one small file is dealt anew before heavy Python work.

    Only inputs with few splits are moved; those of a large table stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_text(docs: DataFrame, id_col: str, text_col: str, fn, schema: str, rows: int = 512, owner: str = "") -> DataFrame:
    """mapInArrow over (id, text) alone: fn(ids, texts as bytes), with at most `rows` texts, gives a dict of columns. owner: as in kept()."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(owner)
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                out = fn(part.column(0).to_pylist(), as_bytes(part.column(1)))
                yield pa.record_batch([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, parsed)


def join_known(rows: DataFrame, known: DataFrame, key: str, size: str = "size") -> DataFrame:
    """rows with the columns of known (one row a key, with the key's number of rows), without the size.

    Keys of more than 1/4096 of the rows (at most 4096) are broadcast, so a key of any size is
    joined without landing in one task; the others are shuffled.
    """
    known = cut(known)
    most = max(1000, (known.agg(F.sum(size)).first()[0] or 0) // 4096)
    hot, cool = known.filter(F.col(size) > most).drop(size), known.filter(F.col(size) <= most).drop(size)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(u long, v long): node, root (the least node it reaches).

    Large-star and small-star rounds on the edge table; each round's edges are cut
    into the shared folder, and nothing but counts comes to the driver. Nodes
    without an edge to another node get no row.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, edges = edges, cut(small.filter("u <> v").distinct())
        last, now = now, state(edges)
        remove(before)
        if now == last:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    ).groupBy("node").agg(F.min("root").alias("root"))


_ODD = 0x9E3779B97F4A7C15
_POWERS = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd number, and of its inverse, modulo 2^64."""
    global _POWERS
    if _POWERS.shape[1] < n:
        size = 1 << (n - 1).bit_length()
        base = np.array([_ODD, pow(_ODD, -1, 1 << 64)], np.uint64)
        out = np.repeat(base[:, None], size, 1)
        out[:, 0] = 1
        _POWERS = np.cumprod(out, axis=1, dtype=np.uint64)
    return _POWERS


def word_spans(raw: bytes, inside: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit polynomial hash of each run of bytes that are in the table `inside`.

    Works block by block (a block ends where a word does), so memory is bounded by the words, not the bytes.
    """
    b, lo, parts = np.frombuffer(raw, np.uint8), 0, []
    while lo < len(b):
        hi = min(lo + block, len(b))
        while hi < len(b) and inside[b[hi - 1]]:  # up to the word's end
            more = np.flatnonzero(~inside[b[hi : hi + block]])
            hi = hi + int(more[0]) + 1 if len(more) else min(hi + block, len(b))
        x = b[lo:hi]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[x], [False]]).view(np.int8)))
        first, end = edge[0::2], edge[1::2]
        up, down = powers(len(x) + 1)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:])
        h = (total[end] - total[first]) * down[first]
        h ^= h >> np.uint64(29)  # low bits of the sum mix few letters
        parts.append((first + lo, end + lo, h * np.uint64(0xBF58476D1CE4E5B9)))
        lo = hi
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(z) for z in zip(*parts, strict=True))
