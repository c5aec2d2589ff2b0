"""Readers: files of several formats as DataFrames; all are distributed scans.

Nothing here caps the number of files or documents. Lines or documents above a
length limit are reported, not read, as the limit is the readers' own rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST_LINE = 200_000
LONGEST_DOCUMENT = 500_000


def without_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^﻿", "")


def read_lines(spark: SparkSession, path: str, glob: str = "*", longest: int = LONGEST_LINE) -> DataFrame:
    """file, line, reason, record: each line of text files, .gz too. reason: blank, too_long, bad_json, not_object, or null for a JSON object."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), without_bom(F.col("value")).alias("line"))
    parsed = F.try_parse_json(F.when(F.length("line") <= longest, F.col("line")))
    kind = F.schema_of_variant(parsed)
    reason = F.when(F.trim("line") == "", "blank").when(F.length("line") > longest, "too_long").when(parsed.isNull(), "bad_json").when(~F.startswith(kind, F.lit("OBJECT")), "not_object")
    return rows.withColumn("reason", reason).withColumn("record", F.when(F.col("reason").isNull(), F.col("line")))


def read_records(spark: SparkSession, path: str, longest: int = LONGEST_DOCUMENT) -> DataFrame:
    """file, record: the JSON objects of .json and .jsonl files; a line that is an array gives its objects; other lines are skipped."""
    rows = read_lines(spark, path, "*.{jsonl,json,jsonl.gz,json.gz}", longest)
    item = F.explode(F.when(F.col("reason").isNull(), F.array("line")).when((F.col("reason") == "not_object") & F.col("line").rlike(r"^\s*\["), F.transform(F.try_variant_get(F.try_parse_json("line"), "$", "array<variant>"), lambda v: F.to_json(v))))
    return rows.select("file", item.alias("record")).filter(F.col("record").rlike(r"^\s*\{"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, record: .jsonl, .json, .txt and .parquet below a path; where there are Parquet files and a dataset.jsonl, only the Parquet files (they hold the same rows)."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    kinds = {r[0] for r in listing.select(F.when(F.col("path").rlike(r"(?i)/dataset\.jsonl$"), "twin").otherwise(F.regexp_extract("path", r"\.([a-z]+)(?:\.gz)?$", 1))).distinct().collect()}
    parts = []
    if "parquet" in kinds:
        table = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
        parts.append(table.select(F.col("_metadata.file_path").alias("file"), F.to_json(F.struct(*table.columns)).alias("record")))
    if not ("parquet" in kinds and "twin" in kinds):
        if kinds & {"json", "jsonl", "twin"}:
            parts.append(read_records(spark, path))
        if "txt" in kinds:
            whole = read_texts(spark, path, "*.txt")
            parts.append(whole.select("file", F.to_json(F.struct("text", F.lit(True).alias("is_txt"))).alias("record")))
    if not parts:
        return spark.createDataFrame([], "file string, record string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sniffed(content: Column) -> Column:
    """Bytes as text: UTF-8 if valid, UTF-16 after a byte-order mark, else Latin-1."""
    mark = F.substring(F.hex(content), 1, 4)
    return F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), without_bom(content.cast("string"))).otherwise(F.decode(content, "ISO-8859-1"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, size, content: whole files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), "content")


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, text: whole files of any of the usual encodings."""
    return read_files(spark, path, glob).select("file", sniffed(F.col("content")).alias("text"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """file, kind, text: the text of .txt, .html, .xml and .csv files by their extension; other kinds have a null text."""
    from ..functions.text import html_text

    rows = read_files(spark, path)
    text = sniffed(F.col("content"))
    kind = F.lower(F.regexp_extract("file", r"\.([A-Za-z]+)$", 1))
    body = F.when(kind.isin("html", "htm"), html_text(text)).when(kind == "xml", xml_text(text)).when(kind == "csv", F.trim(F.regexp_replace(text, "[,;]+", " "))).when(kind.isin("txt", "md"), text)
    return rows.select("file", kind.alias("kind"), body.alias("text"))


def xml_text(c: Column) -> Column:
    """All element texts, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->|<\?.*?\?>", " "), r"<[^>]*>", " ")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """file, text: each CSV row's cells joined by a space."""
    rows = spark.read.option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.concat_ws(" ", *rows.columns).alias("text"))


def read_posts(spark: SparkSession, path: str, column: int = 4, least: int = 200) -> DataFrame:
    """text: one column of a semicolon-separated file with a header, texts of at least `least` characters."""
    rows = spark.read.option("sep", ";").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col(f"`{rows.columns[column]}`").alias("text")).filter(F.length("text") >= least)


def read_feed(spark: SparkSession, path: str, item: str = "item") -> DataFrame:
    """title, link, description, published: the items of RSS files (item) or Atom files (entry)."""
    shape = "title string, link string, description string, summary string, pubDate string, updated string"
    rows = spark.read.format("xml").option("rowTag", item).schema(shape).load(path)
    return rows.select("title", "link", F.coalesce("description", "summary").alias("description"), F.coalesce("pubDate", "updated").alias("published"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word: entries of word lists, lower case, comments and blanks out, each once."""
    rows = spark.read.text(path).select(F.lower(F.trim(without_bom(F.col("value")))).alias("word"))
    return rows.filter(~F.col("word").rlike("^(#|$)")).distinct()


def read_preferred(spark: SparkSession, path: str) -> DataFrame:
    """record: a downloaded data set by the best format present: Parquet, else JSON lines, else CSV."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)(?:\.gz)?$", 1)).alias("k"))
    kinds = {r[0] for r in files.distinct().collect()}
    scan = spark.read.option("recursiveFileLookup", True)
    if "parquet" in kinds:
        table = scan.option("pathGlobFilter", "*.parquet").parquet(path)
    elif kinds & {"json", "jsonl"}:
        return read_records(spark, path).select("record")
    elif "csv" in kinds:
        table = scan.option("pathGlobFilter", "*.csv").option("header", True).csv(path)
    else:
        return spark.createDataFrame([], "record string")
    return table.select(F.to_json(F.struct(*table.columns)).alias("record"))


def pdf_ok(content: Column, least: int = 10_000) -> Column:
    """Whether bytes look like a whole PDF file."""
    return (F.substring(F.hex(content), 1, 10) == F.hex(F.lit("%PDF-"))) & (F.octet_length(content) >= least)


def body_lines(lines: DataFrame, top: float = 0.08, bottom: float = 0.88, least: int = 500) -> DataFrame:
    """doc, text: page lines (doc, page, y, height, line) without heads and feet and lines of under 3 characters, in order; documents of under `least` characters go."""
    place = F.col("y") / F.col("height")
    kept = lines.filter((place >= top) & (place <= bottom) & (F.length(F.trim("line")) >= 3))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "y", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("doc").agg(text.alias("text")).filter(F.length("text") >= least)
