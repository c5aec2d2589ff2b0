"""Sinks: numbered shards, twin outputs with a report, promotion of whole files.

A shard number comes from a row's place in its group. The place is found without one
big sort: rows are counted by range of the order column, offsets are added to places
within a range, so that a hot group is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import conversation as C


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset, a temporary folder in a local run and an error on a cluster."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: ends the lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, group: str, order: str, width: int = 1 << 20) -> DataFrame:
    """df with `place`, the row's number within its group from 0, by a whole-number order column."""
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1
    return ranged.withColumn("_within", within).join(before, [group, "_range"]).withColumn("place", F.col("_before") + F.col("_within")).drop("_range", "_before", "_within")


def sharded(df: DataFrame, group: str, order: str, rows: int = 1000, files: int = 5000) -> DataFrame:
    """df with shard (rows each) and folder (files each) numbers within a group."""
    return placed(df, group, order).withColumn("shard", F.floor(F.col("place") / rows)).withColumn("folder", F.floor(F.col("place") / (rows * files))).drop("place")


def folder_name(group, folder):
    """The group's name, from the second folder on with _002, _003, ..."""
    return F.when(folder == 0, group).otherwise(F.concat(group, F.lit("_"), F.lpad((folder + 1).cast("string"), 3, "0")))


def letters(n) -> Column:
    """1, 2, .. 26, 27, .. as a, b, .. z, aa, ..: numbers up to 26 + 26^2 + 26^3."""
    digit = lambda x: F.char(F.lit(97) + F.pmod(x - 1, F.lit(26)))
    second, third = F.floor((n - 1) / 26), F.floor((F.floor((n - 1) / 26) - 1) / 26)
    return F.concat(F.when(third > 0, digit(third)).otherwise(""), F.when(second > 0, digit(second)).otherwise(""), digit(n))


def character(n) -> Column:
    """The character of a code point; a number that is none (a surrogate, or over 10FFFF) as digits."""
    known = n.between(0, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")).otherwise(n.cast("string"))


def write_shards(df: DataFrame, path: str, group: str, order: str, rows: int = 1000) -> None:
    """JSON lines, one folder a group and shard with exactly `rows` rows but for the last."""
    named = sharded(df, group, order, rows).withColumn("folder", folder_name(F.col(group), F.col("folder")))
    # a shard goes to one task: it has a bounded number of rows
    named.repartition("folder", "shard").sortWithinPartitions("folder", "shard", order).write.partitionBy("folder", "shard").json(path)


def write_twin(messages: DataFrame, path: str) -> DataFrame:
    """conv_id, messages as path/sft, and their texts as path/pretrain; returns the report."""
    kept = messages.withColumn("ok", C.valid(F.col("messages")))
    kept.filter("ok").select("conv_id", "messages").write.parquet(f"{path}/sft")
    kept.select("conv_id", C.pretrain_text(F.col("messages")).alias("text")).filter("text <> ''").write.parquet(f"{path}/pretrain")
    report = kept.agg(F.count("*").alias("read"), F.count_if("ok").alias("sft"), F.count_if(C.pretrain_text(F.col("messages")) != "").alias("pretrain"))
    report.write.json(f"{path}/report")
    return report


def whole_groups(df: DataFrame, group: str, ok) -> DataFrame:
    """Rows of groups all of whose rows are valid."""
    good = df.groupBy(group).agg(F.every(F.coalesce(ok, F.lit(False))).alias("_ok")).filter("_ok")
    return df.join(good.select(group), group, "left_semi")


def manifest(df: DataFrame, size: str, order: str, budget: int) -> DataFrame:
    """Rows in order while their sizes add up to at most a budget: the budget is the feature.

    Sums of ranges come first, so that only the range where the budget ends is summed row by row.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / (1 << 16)))
    sums = ranged.groupBy("_range").agg(F.sum(size).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum").filter(F.col("_before") < budget)
    running = F.col("_before") + F.sum(size).over(Window.partitionBy("_range").orderBy(order))
    return ranged.join(before, "_range").withColumn("_running", running).filter(F.col("_running") <= budget).drop("_range", "_before", "_running")


def _numbered(spark: SparkSession, path: str) -> int:
    """The largest shard number below a path (folders shard=N), or 0. Folder names are all that is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard=*")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    return max((int(f.getPath().getName().removeprefix("shard=")) for f in found or ()), default=0)


def append_shards(df: DataFrame, path: str, order: str, rows: int = 5000) -> None:
    """JSON lines in shards of `rows` rows, numbered on from the largest shard that is there (from 1 on)."""
    start = _numbered(df.sparkSession, path) + 1
    placed_rows = placed(df.withColumn("_all", F.lit(0)), "_all", order).drop("_all")
    shards = placed_rows.withColumn("shard", (F.floor(F.col("place") / rows) + start).cast("int")).drop("place")
    shards.repartition("shard").sortWithinPartitions("shard", order).write.mode("append").partitionBy("shard").json(path)


def append_lots(pairs: DataFrame, path: str, file: str, order: str, rows: int = 500) -> None:
    """Pairs of files that no earlier run has handled, as further shards of `rows` below path/lots.

    What has been handled is read from the lots themselves, so a run that stops before its
    commit leaves nothing half done.
    """
    spark = pairs.sparkSession
    if _numbered(spark, f"{path}/lots"):
        done = spark.read.json(f"{path}/lots").select(F.col(file).cast(pairs.schema[file].dataType)).distinct()
        pairs = pairs.join(done, file, "left_anti")
    if not pairs.isEmpty():
        append_shards(pairs, f"{path}/lots", order, rows)


def exploded(df: DataFrame, group: str, order: str, text: str, big: int = 30_000_000, rows: int = 10) -> DataFrame:
    """df with part: groups (files) of more than `big` bytes are cut into parts of `rows` rows, others are part 0."""
    sizes = df.groupBy(group).agg(F.sum(F.octet_length(text)).alias("_bytes"))
    return placed(df, group, order).join(sizes, group).withColumn("part", F.when(F.col("_bytes") > big, F.floor(F.col("place") / rows)).otherwise(0)).drop("_bytes", "place")
