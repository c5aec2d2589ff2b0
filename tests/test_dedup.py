"""First-wins dedup and containment with null keys, short items, repeated rows and empty tables."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import dedup as D


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_null_keys_are_a_group(spark):
    df = frame(spark, [(1, None), (2, "a"), (3, None), (4, "a"), (5, "null"), (None, "a"), (None, "z"), (6, "")])
    got = {(r["doc_id"], r["is_dup"]) for r in D.duplicates(df, F.col("text"), "doc_id").collect()}
    assert got == {(1, False), (3, True), (2, False), (4, True), (5, False), (6, False), (None, True), (None, False)}
    assert D.duplicates(df, F.col("text"), "doc_id").count() == 8
    kept = sorted((r["doc_id"] or 0, "-" if r["text"] is None else r["text"]) for r in D.first_by(df, F.col("text"), "doc_id").collect())
    assert kept == [(0, "z"), (1, "-"), (2, "a"), (5, "null"), (6, "")]
    assert D.first_by(df.filter("doc_id < 0"), F.col("text"), "doc_id").count() == D.duplicates(df.filter("doc_id < 0"), F.col("text"), "doc_id").count() == 0


def test_contained_items_of_every_length(spark):
    rng = random.Random(1)
    vocab = ["ab", "cd", "efg", "h", "ij"]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for k in range(60)] + [(100, None), (101, ""), (None, "ab cd efg h ij")]
    items = [(k, " ".join(rng.choices(vocab, k=1 + k % 8))) for k in range(24)] + [(50, "fg h ij a"), (51, None), (52, ""), (53, "x"), (54, "g h"), (54, "g h"), (55, "b  cd ef")]
    want = {(i, n) for i, t in docs for n, s in items if s and t and s in t}
    got = D.contained(frame(spark, docs), frame(spark, items).withColumnRenamed("doc_id", "item_id"))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 100
    assert D.contained(frame(spark, docs), frame(spark, []).withColumnRenamed("doc_id", "item_id")).count() == 0
    assert D.contained(frame(spark, []), frame(spark, items).withColumnRenamed("doc_id", "item_id")).count() == 0
