"""The best rows by a score, without one big sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, score: str, ties: list, most: int, buckets: int = 4096) -> DataFrame:
    """The `most` rows with the largest score from 0 to 1, equal scores in the order of `ties`, with place (from 0).

    Rows are counted by score bucket (at most buckets + 1 counts come to the driver); buckets that
    lie wholly above the limit are kept as they are, and places are numbered within buckets, each in a
    task of its own. Null scores count as 0.
    """
    ranged = df.withColumn("_bucket", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(score).cast("double"), F.lit(0.0)))) * buckets))
    before, found = [], 0
    for bucket, n in sorted(map(tuple, ranged.groupBy("_bucket").count().collect()), reverse=True):
        if found >= most:
            break
        before.append((bucket, found))
        found += n
    spark = df.sparkSession
    start = spark.createDataFrame(before, "_bucket long, _before long")  # buckets + 1 rows at most
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.desc_nulls_last(score), *ties)) - 1
    rows = ranged.join(F.broadcast(start), "_bucket").withColumn("place", F.col("_before") + within)
    return rows.filter(F.col("place") < most).drop("_bucket", "_before")

