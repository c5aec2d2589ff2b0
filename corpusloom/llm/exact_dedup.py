"""Exact dedup by two-pass Bloom filtering, in DataFrame functions alone.

Pass one hashes each normalised text to a cell of a bit map and keeps the cells
that more than one row falls into, as bit maps of 32,768 bits. Pass two tests each
row's cells: a row with a cell of its own has no equal, passes straight through and
is never shuffled by its digest; only possible repeats are grouped by SHA-256. A
false positive costs a shuffled row, never a wrong result.

Sizes: the maps hold CELLS_A_ROW cells a row, at most MAX_CELLS (so 64 MB are
broadcast at most, whatever the input; beyond that more rows are shuffled). Groups
of more than 1/4096 of the rows are at most 4096 and are broadcast, so a group of
any size is joined without landing in one task.

Defined cases: a null or blank text counts as its normalised form ('' or ' '); null ids stay as rows
and are never a keep_id unless the whole group has none; of rows with the same id
and text each stays a row, `kept` is true for one id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

MAP_BITS = 32768
CELLS_A_ROW = 32
MAX_CELLS = 1 << 29


def text_digest(text):
    """SHA-256, in lower-case hex, of the text with each run of ASCII white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def possible_repeats(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows with a boolean `maybe`: false only where no other row has the key. n: the number of rows."""
    cells = MAP_BITS
    while cells < min(MAX_CELLS, CELLS_A_ROW * n):
        cells *= 2
    cell = F.pmod(F.xxhash64(key), F.lit(cells))
    seen_again = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).filter("n > 1")
    maps = seen_again.groupBy(F.shiftright("cell", 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("cell").bitwiseAND(MAP_BITS - 1)).alias("bits")
    )
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast((cell & {MAP_BITS - 1}) >> 3 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, cast(cell & 7 as int)) & 1")
    return (
        rows.withColumn("cell", cell)
        .withColumn("bucket", F.shiftright("cell", 15))
        .join(F.broadcast(maps), "bucket", "left")  # MAX_CELLS / 8 bytes at most
        .withColumn("byte", byte)
        .withColumn("maybe", F.coalesce(bit == 1, F.lit(False)))
        .drop("cell", "bucket", "bits", "byte")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row, dropped ones too."""
    digests = cut(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col).cast("string")).alias("text_sha256")))
    n = digests.count()
    flagged = possible_repeats(digests, "text_sha256", n)
    single = flagged.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    again = flagged.filter("maybe").select("doc_id", "text_sha256")
    groups = again.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    hot = groups.filter(F.col("group_size") > max(1000, n // 4096))  # fewer than 4096 groups
    cool = groups.filter(F.col("group_size") <= max(1000, n // 4096))
    known = again.join(F.broadcast(hot), "text_sha256")
    rest = again.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(cool, "text_sha256")
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    rows = single.unionByName(known.select(out)).unionByName(rest.select(out))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
