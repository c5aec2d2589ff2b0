"""Joins against dictionaries, knowledge and evidence, and reports over queues, machines and folders.

Dictionaries and knowledge are ordinary tables: Catalyst broadcasts them if they are small and
shuffles otherwise. Null texts and keys match nothing; rows without a match stay where stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which treatment a folder's format calls for, in the order in which formats count.
TREATMENT = {"jsonl": "sanitise", "parquet": "light_clean", "csv": "light_clean", "txt": "encoding", "json": "sanitise"}


def category_hits(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 3, block: int = 2000) -> DataFrame:
    """id, category, item (the category's first found term), hits, place: the `top` categories by how many of their terms a text contains.

    terms: category, rank (order within the category), term. A term of three characters must be a
    word between spaces; a longer one may stand anywhere; shorter ones don't count. Terms go with
    the plan, `block` at a time: a block is a stretch of literal searches over the text, which is
    scanned once a block and never shuffled; only hits are.
    """
    known = terms.select("category", "rank", F.trim(F.lower("term")).alias("term")).filter(F.length("term") >= 3).distinct().orderBy("category", "rank", "term")
    rows = known.collect()  # the dictionary, which the caller bounds
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("t")).withColumn("padded", F.concat(F.lit(" "), "t", F.lit(" ")))
    parts = []
    for lo in range(0, len(rows), block):
        some = rows[lo : lo + block]
        listed = F.array(*[F.struct(F.lit(r[0]).alias("category"), F.lit(r[1]).cast("long").alias("rank"), F.lit(r[2]).alias("term")) for r in some])
        present = F.filter(listed, lambda x: F.when(F.length(x["term"]) < 4, F.contains("padded", F.concat(F.lit(" "), x["term"], F.lit(" ")))).otherwise(F.contains("t", x["term"])))
        parts.append(low.select("id", F.explode(present).alias("x")).select("id", "x.category", "x.rank", "x.term"))
    if not parts:
        return low.select("id", F.lit("").alias("category"), F.lit("").alias("item"), F.lit(0).cast("long").alias("hits"), F.lit(0).alias("place")).filter("false")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    counts = found.groupBy("id", "category").agg(F.min_by("term", F.struct("rank", "term")).alias("item"), F.count("*").alias("hits"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hits"), "category"))  # a document has as many rows as categories at most
    return counts.withColumn("place", place).filter(F.col("place") <= top)


def known_context(rows: DataFrame, base: DataFrame, topic: str) -> DataFrame:
    """rows with context and source from base (topic, context, source) by the topic in lower case; empty strings where there is none."""
    facts = base.select(F.lower(F.trim("topic")).alias("_topic"), "context", "source").groupBy("_topic").agg(F.max(F.struct("context", "source")).alias("_fact"))
    joined = rows.withColumn("_topic", F.lower(F.trim(F.col(topic)))).join(facts, "_topic", "left")
    return joined.select(*rows.columns, F.coalesce("_fact.context", F.lit("")).alias("context"), F.coalesce("_fact.source", F.lit("")).alias("source"))


def verified_claims(claims: DataFrame, results: DataFrame, words: int = 4) -> DataFrame:
    """claim_id, verdict (confirmed, not_found or no_search), source, title, hits: by the search result with most of the claim's first terms.

    claims: claim_id, terms (array); results: claim_id, source, title, text. Of equal results the first by source and title counts.
    """
    asked = claims.select("claim_id", F.transform(F.slice("terms", 1, words), F.lower).alias("t"))
    blob = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    joined = asked.join(results.select("claim_id", "source", "title", blob.alias("blob")), "claim_id", "left")
    hits = F.when(F.col("blob").isNotNull(), F.size(F.filter("t", lambda x: F.contains("blob", x)))).otherwise(-1)
    best = joined.select("claim_id", "t", "source", "title", hits.alias("hits")).groupBy("claim_id").agg(F.first("t").alias("t"), F.min(F.struct((-F.col("hits")).alias("less"), "source", "title")).alias("b"))
    enough = -F.col("b.less") >= F.greatest(F.lit(2), F.floor(F.size("t") / 2))
    verdict = F.when((F.size("t") < 1) | (F.col("b.less") > 0), "no_search").when(enough, "confirmed").otherwise("not_found")
    return best.select("claim_id", verdict.alias("verdict"), F.when(enough, F.col("b.source")).alias("source"), F.when(enough, F.col("b.title")).alias("title"), F.greatest(F.lit(0), -F.col("b.less")).alias("hits"))


def queue_report(orders: DataFrame, cost: dict[str, int], default: int = 40) -> DataFrame:
    """waiting, running, done, error, seconds: counts of orders (status, goal, templates) and the time that those ahead will take."""
    table = F.create_map(*[F.lit(x) for pair in (cost | {"": default}).items() for x in pair])
    each = F.array_max(F.transform("templates", lambda t: F.coalesce(F.try_element_at(table, t), F.lit(default))))
    everything = F.col("templates").isNull() | (F.size("templates") == 0) | F.col("templates").eqNullSafe(F.array(F.lit("todos")))
    seconds = F.when(F.col("status").isin("aguardando", "rodando"), F.coalesce(F.nullif("goal", F.lit(0)), F.lit(1)) * F.when(everything, default).otherwise(each)).otherwise(0)
    n = lambda s: F.count_if(F.col("status") == s)
    return orders.agg(n("aguardando").alias("waiting"), n("rodando").alias("running"), n("concluido").alias("done"), n("erro").alias("error"), F.coalesce(F.sum(seconds), F.lit(0)).alias("seconds"))


def requeued(orders: DataFrame) -> DataFrame:
    """Orders that no worker runs any more wait again."""
    return orders.withColumn("status", F.when(F.col("status") == "rodando", "aguardando").otherwise(F.col("status")))


def disk_band(gigabytes: Column) -> Column:
    return F.when(gigabytes > 10, "green").when(gigabytes > 5, "yellow").when(gigabytes.isNotNull(), "red")


def memory_band(megabytes: Column) -> Column:
    return F.when(megabytes / 1024 > 2, "green").when(megabytes.isNotNull(), "red")


def processor_band(percent: Column) -> Column:
    return F.when(percent < 65, "green").when(percent < 85, "yellow").when(percent.isNotNull(), "red")


def throughput(read: Column, total: Column, seconds: Column) -> Column:
    """struct(rate: rows a second, minutes: left at that rate), both at least one in the divisor."""
    rate = read / F.greatest(F.lit(1.0), seconds)
    return F.struct(rate.alias("rate"), ((total - read) / F.greatest(F.lit(1.0), rate) / 60).alias("minutes"))


def folder_formats(files: DataFrame, path: str = "path") -> DataFrame:
    """folder, format (the first of jsonl, parquet, csv, txt, json that it holds), treatment, files: by extensions."""
    extension = F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1))
    rows = files.select(F.regexp_extract(F.col(path), "^(.*)/[^/]*$", 1).alias("folder"), extension.alias("e"))
    flags = rows.groupBy("folder").agg(F.count("*").alias("files"), F.bool_or(F.col("e") != "").alias("_any"), *[F.bool_or(F.col("e") == k).alias(k) for k in TREATMENT])
    kind = F.coalesce(*[F.when(F.col(k), F.lit(k)) for k in TREATMENT], F.when(F.col("_any"), F.lit("other")), F.lit("empty"))
    treat = F.create_map(*[F.lit(x) for pair in TREATMENT.items() for x in pair])
    return flags.select("folder", kind.alias("format"), F.coalesce(F.try_element_at(treat, kind), F.lit("none")).alias("treatment"), "files")


def hub_tags(tags: Column) -> Column:
    """struct(size, format, languages) of a list of 'name:value' tags."""
    of = lambda name: F.transform(F.filter(tags, lambda t: F.startswith(t, F.lit(name + ":"))), lambda t: F.substr(t, F.lit(len(name) + 2)))
    return F.struct(F.get(of("size_categories"), F.lit(0)).alias("size"), F.get(of("format"), F.lit(0)).alias("format"), of("language").alias("languages"))


def middle_files(files: DataFrame, rows: str = "rows", path: str = "path") -> DataFrame:
    """files with part: val for a tenth (one at least, if there are two files) of middle size, train for the others.

    Files are ranked by rows and path. The list of files is metadata: one row a file.
    """
    n = files.count()
    size = max(1, int(n * 0.1)) if n >= 4 else min(1, n // 2)
    start = max(0, (n - size) // 2)
    place = F.row_number().over(Window.orderBy(rows, path)) - 1
    return files.withColumn("_place", place).withColumn("part", F.when(F.col("_place").between(start, start + size - 1), "val").otherwise("train")).drop("_place")


def preferred(pages: DataFrame, preference: str, most: int, date: str = "date", words: str = "words", order: str = "url") -> DataFrame:
    """At most `most` pages, newest or longest first, or in order: the limit is the feature."""
    keys = {"new": [F.coalesce(F.col(date).cast("string"), F.lit("")).desc()], "complex": [F.coalesce(F.col(words), F.lit(0)).desc()]}.get(preference, [])
    return pages.orderBy(*keys, order).limit(most)
