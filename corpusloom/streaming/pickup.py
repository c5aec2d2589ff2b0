"""File pickup by Structured Streaming: files already handled are skipped after a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick_up(spark: SparkSession, source: str, target: str, state: str, schema, step: Callable[[DataFrame], DataFrame], glob: str = "*.parquet", files_a_batch: int = 1000) -> None:
    """Run step over the Parquet files below source that state doesn't know yet, add the rows to target, then stop.

    state holds the checkpoint: a run that is stopped goes on where it was, and a finished file isn't read twice.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", glob).parquet(source)
    query = step(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def first_seen(rows: DataFrame, key: str, time: str, horizon: str = "1 day") -> DataFrame:
    """The first row of each key within a time horizon; unlike the batch dedup, a key seen again after it counts as new."""
    return rows.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def counts_by_window(rows: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by time window and a column; windows close when the watermark has passed."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def drain(rows: DataFrame, target: str, state: str, mode: str = "append") -> None:
    """Run a stream over what is there now and stop. mode 'append' adds finished rows to target; 'complete' replaces target by the whole result after each batch."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
