"""First-wins dedup and overlap operators.

Null keys are equal to each other, as GROUP BY has it; a null order column is never the
first where its key has another, and rows that repeat key and order are alike.
"""

from __future__ import annotations

from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import spread


def key_digest(key: Column) -> Column:
    """128 bits of a key; a null key has a digest that no text has."""
    return F.coalesce(F.md5(key), F.lit("null"))


def first_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, in the order of an order column.

    The key's first order value is found by a partial aggregate, so a frequent key
    costs one row a task; a second join brings back the rows.
    """
    keyed = df.withColumn("_key", key_digest(key)).withColumn("_order", F.col(order))
    first = keyed.groupBy("_key").agg(F.min("_order").alias("_first")).withColumnRenamed("_key", "_group")
    same = (F.col("_key") == F.col("_group")) & F.col("_order").eqNullSafe(F.col("_first"))
    return keyed.join(first, same, "left_semi").drop("_key", "_order")


def duplicates(df: DataFrame, key: Column, order: str) -> DataFrame:
    """order column, is_dup: whether an earlier row has the key."""
    keyed = df.select(order, key_digest(key).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    return keyed.join(first, "_key").select(order, F.coalesce(F.col(order) > F.col("_first"), F.col("_first").isNotNull()).alias("is_dup"))


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", most: int = 7) -> DataFrame:
    """doc_id, item_id of the documents whose text contains an item's text: an equi-join on inner words, then the exact test.

    An item's first and last word may be cut off by the document's words around them, so the
    key is the item's next words, `most` at most; an item of two words or fewer has none and is
    keyed by its first letters. Documents give a row of (key, row hash) for each place, and a
    length of key that some item has; texts are fetched for candidates alone. Items
    of the same text are each reported. Null and empty items are contained in nothing, null texts
    contain nothing; null ids are kept.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    key = F.xxhash64(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("row"), F.col(text).alias("dt")).filter("dt is not null")
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("it"), words(F.col(text)).alias("w")).filter("it <> ''")
    long = wanted.filter("size(w) > 2").withColumn("n", F.least(F.size("w") - 2, F.lit(most)))
    long = long.select("item_id", "it", F.concat(F.lit("w"), "n").alias("kind"), F.xxhash64(F.slice("w", F.lit(2), F.col("n"))).alias("k"))
    short = wanted.filter("size(w) <= 2").withColumn("n", F.least(F.length("it"), F.lit(most)))
    short = short.select("item_id", "it", F.concat(F.lit("c"), "n").alias("kind"), F.xxhash64(F.substr("it", F.lit(1), F.col("n"))).alias("k"))
    keyed = long.unionByName(short)
    def keys(kind: str) -> DataFrame:
        n = int(kind[1:])
        if kind[0] == "w":
            one = rows.select("row", words(F.col("dt")).alias("w")).filter(F.size("w") >= n)
            found = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n)))
        else:
            one = rows.filter(F.length("dt") >= n).select("row", "dt")
            found = F.transform(F.sequence(F.lit(1), F.length("dt") - (n - 1)), lambda i: F.xxhash64(F.substr("dt", i, F.lit(n))))
        return one.select("row", F.lit(kind).alias("kind"), F.explode(F.array_distinct(found)).alias("k"))

    parts = [keys(r[0]) for r in keyed.select("kind").distinct().collect()]  # 2 * most at most
    if not parts:
        return rows.join(keyed, F.lit(False)).select("doc_id", "item_id")
    near = reduce(DataFrame.unionByName, parts).join(keyed, ["kind", "k"]).select("row", "item_id", "it").distinct()
    return near.join(rows, "row").filter(F.contains("dt", "it")).select("doc_id", "item_id").distinct()


def overlap(df: DataFrame, group: str, key: Column) -> DataFrame:
    """Pairs of groups with the number of distinct keys they share, and their share of the second's keys.

    Keys are first counted by the set of groups that have them, so a pair is emitted once a
    distinct set of groups, not once a key. A key's set has at most as many elements as there are groups.
    """
    keys = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), key_digest(key).alias("k")).distinct()
    sizes = keys.groupBy("g").agg(F.count("*").alias("n"))
    sets = keys.groupBy("k").agg(F.array_sort(F.collect_set("g")).alias("s")).filter("size(s) > 1").groupBy("s").agg(F.count("*").alias("c"))
    both = sets.select("s", "c", F.explode("s").alias("a")).select("c", "a", F.explode("s").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.sum("c").alias("shared"))
    return both.join(sizes.withColumnRenamed("g", "b"), "b").select("a", "b", "shared", (F.col("shared") / F.col("n")).alias("share"))


def minus(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Rows not processed yet."""
    return df.join(done.select(on).distinct(), on, "left_anti")


def recent_duplicates(df: DataFrame, group: str, order: str, key: str, last: int = 1000) -> DataFrame:
    """Whether the key occurred among the group's last rows: by the distance to the key's row before, without a window of rows for each row."""
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    before = F.lag("_place").over(Window.partitionBy(group, key).orderBy(order))
    return placed.withColumn("seen", F.coalesce(F.col("_place") - before <= last, F.lit(False))).drop("_place")


def minhash_near(df: DataFrame, text: Column, order: str, perms: int = 128, rows: int = 8, threshold: float = 0.8, cut=lambda t: t.checkpoint(), deal: bool = True) -> DataFrame:
    """order column, duplicate_of: rows that repeat an earlier row that is kept.

    Rows are taken in order; a row is a duplicate if a kept row before it shares a band
    of min-hashes and its word set has a Jaccard similarity of at least the threshold.
    Equal word sets meet in one row beforehand. This is settled in rounds without pairing
    the rows of a band: a row that is first in all its bands is kept, and each band's
    other rows are compared with its first row alone, so a round compares each row with
    at most as many rows as there are bands, however many share one. Rows compared in
    vain go on to the next round. cut ends the lineage of a round. Rows without words or
    with a null order are never duplicates. deal: spread a table of few splits over the cores
    first (asking for the splits would run the shuffles of a df that isn't a plain scan).
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"(?U)\w+"), F.lit(0))))
    found = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.md5(F.array_join(w, " ")).alias("set")))[0]  # the words are found once
    rows_in = df.select(F.col(order).alias("o"), text.alias("_text")).filter("o is not null")
    keyed = (spread(rows_in) if deal else rows_in).select("o", found.alias("x")).select("o", "x.w", "x.set")
    keyed = cut(keyed).filter("size(w) > 0")
    sets = cut(keyed.groupBy("set").agg(F.min("o").alias("o"), F.first("w").alias("w")))

    odd = np.random.default_rng(11).integers(1, 1 << 62, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf("array<long>")  # a native form (a lambda over the words for each seed) took five times as long
    def bands(joined: pd.Series) -> pd.Series:
        def keys(ws: str) -> np.ndarray:
            h = np.fromiter((crc32(w.encode()) for w in ws.split(" ")), np.uint64) + np.uint64(1)
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h << np.uint64(17))
            least = np.full(perms, np.iinfo(np.uint64).max, np.uint64)
            for lo in range(0, len(h), 4096):
                np.minimum(least, (h[lo : lo + 4096] * odd[:, None]).min(1), out=least)
            out = np.arange(1, perms // rows + 1, dtype=np.uint64)
            for part in least.reshape(-1, rows).T:
                out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + part
            return out.view(np.int64)

        return joined.map(keys)

    banded = cut(spread(sets).select("o", F.explode(bands(F.array_join("w", " "))).alias("k")))
    live = cut(banded.join(banded.groupBy("k").count().filter("count > 1").select("k"), "k", "left_semi"))
    found = []
    while not live.isEmpty():
        firsts = live.join(live.groupBy("k").agg(F.min("o").alias("m")), "k")
        kept = firsts.groupBy("o").agg(F.every(F.col("o") == F.col("m")).alias("kept")).filter("kept").select("o")
        pairs = firsts.filter("o <> m").select("o", "m").distinct().join(kept.select(F.col("o").alias("m")), "m", "left_semi")
        sides = pairs.join(sets.select("o", F.col("w").alias("p")), "o").join(sets.select(F.col("o").alias("m"), F.col("w").alias("q")), "m")
        shared = F.size(F.array_intersect("p", "q"))
        close = cut(sides.filter(shared >= threshold * (F.size("p") + F.size("q") - shared)).groupBy("o").agg(F.min("m").alias("duplicate_of")))
        found.append(close)
        live = cut(live.join(kept.unionByName(close.select("o")), "o", "left_anti"))
    near = found[0] if found else sets.filter("false").select("o", F.col("o").alias("duplicate_of"))
    for part in found[1:]:
        near = near.unionByName(part)
    first = sets.select("set", F.col("o").alias("first")).join(near.withColumnRenamed("o", "first"), "first", "left")
    out = keyed.select("o", "set").join(first, "set").filter("o <> first or duplicate_of is not null")
    return out.select(F.col("o").alias(order), F.coalesce("duplicate_of", "first").alias("duplicate_of"))
