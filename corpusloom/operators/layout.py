"""How rows are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """At least two tasks a core: a table in one small file is dealt anew before heavy work on each row.

    Only inputs with few splits are moved; those of a large table stay where they are. For scans
    and what is computed row by row from them: the splits of a shuffled df are known only after its shuffles ran.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
