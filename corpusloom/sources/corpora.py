"""Rules of corpus readers: limits in bytes or rows, turns joined to texts, members of archives.

Null and empty texts are left out where a rule asks for a length; members of archives whose
names lead out of the archive are skipped; broken archives give no rows.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def limited(df: DataFrame, order: str, text: str, most_bytes: int | None = None, most_rows: int | None = None, width: int = 1 << 16) -> DataFrame:
    """Rows in order until their texts have `most_bytes` (the row that reaches it is the last) or there are `most_rows`: the limits are the feature.

    Bytes and rows are summed by range of the order column first, so only the ranges before the
    limit are summed row by row, each in a task of its own.
    """
    sized = df.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("_range").agg(F.sum("_bytes").alias("_b"), F.count("*").alias("_n"))
    before = sums.select("_range", F.coalesce(F.sum("_b").over(upto), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"))
    ok = lambda b, n: (F.lit(True) if most_bytes is None else b < most_bytes) & (F.lit(True) if most_rows is None else n < most_rows)
    near = sized.join(before.filter(ok(F.col("_b0"), F.col("_n0"))), "_range")
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = near.withColumns({"_b1": F.col("_b0") + F.coalesce(F.sum("_bytes").over(within), F.lit(0)), "_n1": F.col("_n0") + F.coalesce(F.count("*").over(within), F.lit(0))})
    return rows.filter(ok(F.col("_b1"), F.col("_n1"))).select(*df.columns)


def joined_turns(turns: DataFrame, conversation: str, order: str, text: str) -> DataFrame:
    """conversation, text: each conversation's texts that aren't empty, in order, joined by a space."""
    said = turns.filter(F.col(text) != "").groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_t"))
    return said.select(conversation, F.array_join(F.transform("_t", lambda x: x[text]), " ").alias("text"))


def members(raw: bytes, name: str) -> Iterator[tuple[str, bytes]]:
    """Name and content of the files in a zip, tar (compressed or not) or gzip file."""
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
        return
    except tarfile.TarError:
        pass
    if raw[:2] == b"\x1f\x8b":
        yield posixpath.basename(name).removesuffix(".gz"), gzip.decompress(raw)


def safe(name: str) -> bool:
    """Whether a member's name stays below the folder that it is extracted to."""
    flat = posixpath.normpath(name.replace("\\", "/"))
    return not (flat.startswith(("/", "../")) or flat == ".." or flat[1:2] == ":")


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, content: the files in the archives below a path, an archive a row of the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{zip,tar,tgz,gz}").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    for member, data in members(content.as_py(), name):
                        if safe(member):
                            yield pa.record_batch({"archive": [name], "member": [member], "content": pa.array([data], pa.binary())})
                except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error):
                    continue  # a broken archive gives what came before

    return files.mapInArrow(run, "archive string, member string, content binary")
