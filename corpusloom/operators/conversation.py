"""Turns, messages, pairs and validity of chat data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Role names of the formats read.
ROLES = {"human": "user", "humano": "user", "h": "user", "usuario": "user", "pessoa": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "modelo": "assistant", "a": "assistant", "ia": "assistant", "assistente": "assistant"}


def role_name(c: Column, names: dict[str, str] = ROLES) -> Column:
    low = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(known, low), low)


def messages(turns: DataFrame) -> DataFrame:
    """conv_id, messages: each conversation's turns in order."""
    rows = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role_name(F.col("role")).alias("role"), F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """User turns followed at once by an assistant's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    role = role_name(F.col("role"))
    rows = turns.select("conv_id", "turn", role.alias("r"), F.col("text").alias("question"), F.lead(role).over(w).alias("nr"), F.lead("text").over(w).alias("answer"))
    return rows.filter("r = 'user' and nr = 'assistant' and trim(question) <> '' and trim(answer) <> ''").select("conv_id", "turn", "question", "answer")


def last_user_pairs(turns: DataFrame) -> DataFrame:
    """Assistant turns with the latest user turn since the pair before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.filter("trim(text) <> '' and role in ('user', 'assistant')").withColumn("pr", F.lag("role").over(w)).withColumn("question", F.lag("text").over(w))
    return rows.filter("role = 'assistant' and pr = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def valid(messages: Column) -> Column:
    """Two messages at least, known roles, no blank content."""
    return (F.size(messages) >= 2) & F.forall(messages, lambda m: m["role"].isin("system", "user", "assistant") & (F.trim(m["content"]) != ""))


def pretrain_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n\n")


def lookahead_pairs(turns: DataFrame, least: int = 5) -> DataFrame:
    """User turns with the next assistant turn before another user turn (system turns in between don't count); answers of `least` words or more."""
    role = F.lower(F.trim("role"))
    side = F.when(role == "user", "user").when(role.isin("assistant", "bot"), "assistant")
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = turns.select("conv_id", "turn", "text", side.alias("r")).filter("r is not null")
    rows = said.select("conv_id", "turn", "r", F.trim("text").alias("question"), F.lead("r").over(w).alias("nr"), F.trim(F.lead("text").over(w)).alias("answer"))
    return rows.filter("r = 'user' and nr = 'assistant' and question <> ''").filter(F.regexp_count("answer", F.lit(r"\S+")) >= least).select("conv_id", "turn", "question", "answer")
