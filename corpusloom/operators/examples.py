"""Training examples out of JSON records of several shapes.

A record is a JSON object as text. Shapes: messages / conversations / conversation /
chat (an array, or an array as text), instruction with input and output, prompt with
completion or answer, and plain text or content. What fits none gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conversation import role_name

TURN = "array<struct<role:string,from:string,content:string,value:string,text:string>>"
#: Names that each format gives the same role; other roles are dropped.
CORE_ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "model": "assistant", "system": "system"}
DEFAULT_SYSTEM = "Você é um assistente útil."


def _first(record: Column, *keys: str) -> Column:
    """The first of the keys whose value isn't blank, trimmed; or null."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(record, f"$.{k}")), F.lit("")) for k in keys])


def record_messages(record: Column) -> Column:
    """array<struct<role, content>> with at least two turns, or null."""
    raw = _first(record, "messages", "conversations", "conversation", "chat")
    turns = F.from_json(raw, TURN)
    role = lambda t: F.element_at(F.create_map(*[F.lit(x) for kv in CORE_ROLES.items() for x in kv]), F.lower(F.coalesce(t["role"], t["from"], F.lit(""))))
    known = F.filter(F.transform(turns, lambda t: F.struct(role(t).alias("role"), F.trim(F.coalesce(F.nullif(t["content"], F.lit("")), F.nullif(t["value"], F.lit("")), F.nullif(t["text"], F.lit("")))).alias("content"))), lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    strings = F.transform(F.from_json(raw, "array<string>"), lambda s, i: F.struct(F.when(i % 2 == 1, "assistant").otherwise("user").alias("role"), F.trim(s).alias("content")))
    is_text = F.substring(F.regexp_replace(raw, r"^\[\s*", ""), 1, 1) == '"'
    listed = F.when(is_text, strings).otherwise(known)
    ask, more, answer = _first(record, "instruction", "prompt"), _first(record, "input"), _first(record, "output", "completion", "answer")
    pair = F.array(F.struct(F.lit("user").alias("role"), F.concat_ws("\n\n", ask, more).alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return F.when(raw.isNotNull(), F.when(F.size(listed) >= 2, listed)).when(ask.isNotNull() & answer.isNotNull(), pair)


def with_system(messages: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """Messages without blank contents, with a system message in front."""
    kept = F.filter(messages, lambda m: F.trim(m["content"]) != "")
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return F.when(F.get(kept, F.lit(0))["role"] == "system", kept).otherwise(F.concat(first, kept))


def record_text(record: Column) -> Column:
    """The text filters look at: text or content, instruction and output, or the messages' contents."""
    ask, answer = _first(record, "instruction", "prompt"), _first(record, "output", "completion", "answer")
    return F.coalesce(_first(record, "text", "content"), F.when(ask.isNotNull() | answer.isNotNull(), F.concat_ws("\n\n", ask, answer)), F.array_join(F.transform(record_messages(record), lambda m: m["content"]), "\n"), F.lit(""))


def causal_text(record: Column) -> Column:
    """text or content of a record that isn't a conversation, or null."""
    return F.when(record_messages(record).isNull(), _first(record, "text", "content"))


def standard_example(messages: Column, kind: Column) -> Column:
    """struct(system, user, assistant, id, kind, subject, mark) or null without a user and an assistant turn."""
    said = lambda *names: F.get(F.filter(messages, lambda m: role_name(m["role"]).isin(*names)), F.lit(0))["content"]
    user, answer, system = said("user"), said("assistant"), F.coalesce(said("system"), F.lit(DEFAULT_SYSTEM))
    bare = F.trim(F.regexp_replace(F.trim(user), r"(?i)^(Escreva sobre o tema:|Conte sobre:|Fale sobre:)", ""))
    subject = F.when((bare == "") | F.startswith(bare, F.lit("massa_")), "tema geral").otherwise(bare)
    known = F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit("artigo"))
    made = F.struct(
        system.alias("system"), user.alias("user"), answer.alias("assistant"), F.substring(F.md5(F.concat_ws("|", user, answer)), 1, 16).alias("id"),
        F.when((known == "artigo") & F.contains(user, F.lit("?")), "qna").otherwise(known).alias("kind"), subject.alias("subject"), F.lit(4).alias("mark"),
    )
    return F.when((user != "") & (answer != ""), made)


def training_rows(examples: DataFrame, encode, begin: int, end: int, separator: int, pad: int, length: int) -> DataFrame:
    """ids and labels of each example (id, messages), `length` long: system, user and assistant blocks, each followed by a separator.

    encode: a function of a text to ids, shipped to the workers. Labels are ids of the
    assistant's blocks and -100 elsewhere. What is too long loses its beginning: first
    what precedes the answer. Examples without a question or an answer give no row.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for key, messages in zip(batch["id"], batch["messages"], strict=True):
                by = {r: [encode(m["content"] or "") for m in messages if m["role"] == r] for r in ("system", "user", "assistant")}
                if not by["user"] or not any(by["assistant"]):
                    continue
                ids, wanted = [begin], [False]
                for r in ("system", "user", "assistant"):
                    for block in filter(None, by[r]):
                        ids += [*block, separator]
                        wanted += [r == "assistant"] * len(block) + [False]
                ids[-1] = end
                ids, wanted = ids[-length:], wanted[-length:]
                if any(wanted):
                    spare = length - len(ids)
                    out.append((key, ids + [pad] * spare, [i if w else -100 for i, w in zip(ids, wanted, strict=True)] + [-100] * spare))
            yield pd.DataFrame(out, columns=["id", "ids", "labels"])

    import pandas as pd

    return examples.select("id", "messages").mapInPandas(run, "id long, ids array<int>, labels array<int>")
