"""Questions and answers from serialised prompts, marked lines, blocks and records of unknown structure.

Null texts give null (scalars) or no pairs (arrays); texts without marks give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks a question, an answer, and an answer on the question's line.
ASKS = r"(?iu)^\s*(?:pergunta|p|q|user|humano|h|usu[áa]rio)\s*[:：]\s*(.*)$"
ANSWERS = r"(?iu)^\s*(?:resposta|r|a|assistente|bot|gpt|model)\s*[:：]\s*(.*)$"
INLINE = r"(?iu)\b(?:resposta|assistente|bot|gpt|model)\s*[:：]\s*"
PAIRS = "array<struct<question string, answer string>>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def serialised_prompt(c: Column) -> Column:
    """A prompt as it is, or, if it is a list of messages in JSON or with single quotes, what its user and system messages say."""
    t = strip(F.coalesce(c, F.lit("")))
    messages = F.from_json(F.when(F.startswith(t, F.lit("[")), t), "array<struct<role string, from string, content string, value string>>", {"allowSingleQuotes": "true"})
    said = F.filter(messages, lambda m: F.lower(F.coalesce(F.nullif(m["role"], F.lit("")), m["from"])).isin("user", "human", "h", "system") & (F.coalesce(F.nullif(m["content"], F.lit("")), m["value"], F.lit("")) != ""))
    text = strip(F.array_join(F.transform(said, lambda m: strip(F.coalesce(F.nullif(m["content"], F.lit("")), m["value"]))), " "))
    return F.when(F.size(said) > 0, text).otherwise(t)


def line_pairs(c: Column) -> Column:
    """Pairs of a text whose lines are marked: a marked line begins a question or an answer, unmarked lines go on with it.

    A line with both marks is a pair of its own and ends what was open. Questions without an
    answer before the text's end, and answers without a question, give nothing.
    """
    blank = F.struct(F.lit("").alias("mode"), F.array().cast("array<string>").alias("q"), F.array().cast("array<string>").alias("a"), F.array().cast(PAIRS).alias("out"))

    def one(q: Column, a: Column) -> Column:
        return F.when((q != "") & (a != ""), F.array(F.struct(q.alias("question"), a.alias("answer")))).otherwise(F.array().cast(PAIRS))

    def pair(s: Column) -> Column:
        return one(strip(F.array_join(F.transform(s["q"], strip), " ")), strip(F.array_join(F.transform(s["a"], strip), " ")))

    def state(mode, q, a, out) -> Column:
        return F.struct(F.lit(mode).alias("mode") if isinstance(mode, str) else mode.alias("mode"), q.alias("q"), a.alias("a"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        asks, answers = x.rlike(ASKS), x.rlike(ANSWERS)
        asked = F.regexp_extract(x, ASKS, 1)
        both = F.split(asked, INLINE, 2)
        none = F.array().cast("array<string>")
        settled = F.when(s["mode"] == "a", F.concat(s["out"], pair(s))).otherwise(s["out"])
        kept_q, kept_a = (F.when(s["mode"] == "a", none).otherwise(s[k]) for k in ("q", "a"))
        return (
            F.when(asks & (F.size(both) > 1), state("", none, none, F.concat(settled, one(strip(both[0]), strip(both[1])))))
            .when(asks, state("q", F.concat(kept_q, F.array(asked)), kept_a, settled))
            .when(answers, state("a", s["q"], F.concat(s["a"], F.array(F.regexp_extract(x, ANSWERS, 1))), s["out"]))
            .when(s["mode"] == "q", state("q", F.concat(s["q"], F.array(x)), s["a"], s["out"]))
            .when(s["mode"] == "a", state("a", s["q"], F.concat(s["a"], F.array(x)), s["out"]))
            .otherwise(s)
        )

    return F.aggregate(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), blank, step, lambda s: F.concat(s["out"], F.when((s["mode"] == "a") | (F.size(s["q"]) > 0) & (F.size(s["a"]) > 0), pair(s)).otherwise(F.array().cast(PAIRS))))


def block_pairs(c: Column) -> Column:
    """Pairs of a text's blank-line blocks: the last line that begins with each mark."""

    def last(block: Column, mark: str) -> Column:
        found = F.filter(F.split(strip(block), "\n"), lambda x: F.startswith(x, F.lit(mark)))
        return F.when(F.size(found) > 0, strip(F.replace(F.element_at(found, -1), F.lit(mark), F.lit(""))))

    made = F.transform(F.split(strip(F.coalesce(c, F.lit(""))), "\n\n"), lambda b: F.struct(last(b, "Pergunta:").alias("question"), last(b, "Resposta:").alias("answer")))
    return F.filter(made, lambda p: (F.coalesce(p["question"], F.lit("")) != "") & (F.coalesce(p["answer"], F.lit("")) != ""))


def record_structure(record: Column) -> Column:
    """How a JSON record holds a conversation: struct(key, kind: pairs, turns or null, ask, answer: the keys or roles of either side)."""
    keys = ["conversa", "conversations", "chat", "dialog", "turns"]
    held = [F.get_json_object(record, f"$.{k}") for k in keys]
    found = F.coalesce(*held)
    key = F.coalesce(*[F.when(h.isNotNull(), F.lit(k)) for k, h in zip(keys, held, strict=True)])
    turns = F.from_json(F.when(F.startswith(strip(found), F.lit("[")), found), "array<map<string,string>>", {"allowSingleQuotes": "true"})
    first = F.map_keys(F.get(turns, F.lit(0)))
    has = lambda *names: F.size(F.array_intersect(first, F.array(*[F.lit(n) for n in names]))) == len(names)
    kind = F.when(has("humano", "assistente"), "pairs").when(has("role", "content") | has("from", "value"), "turns").when(F.size(first) > 0, "pairs")
    roles = F.transform(F.slice(turns, 1, 10), lambda t: F.lower(F.coalesce(F.try_element_at(t, F.lit("role")), F.try_element_at(t, F.lit("from")))))
    of = lambda names, other: F.when(F.size(F.array_intersect(roles, F.array(*[F.lit(n) for n in names]))) > 0, F.array_sort(F.array_intersect(roles, F.array(*[F.lit(n) for n in names])))).otherwise(F.array(F.lit(other)))
    side = lambda pair, names, other, k: F.when(kind == "turns", of(names, other)).when(has("humano", "assistente"), F.array(F.lit(pair[0]))).when(has("user", "assistant"), F.array(F.lit(pair[1]))).when(kind == "pairs", F.filter(F.array(F.get(first, F.lit(k))), lambda x: x.isNotNull()))
    ask = side(("humano", "user"), ["user", "human", "humano"], "user", 0)
    answer = side(("assistente", "assistant"), ["assistant", "assistente", "gpt", "ai"], "assistant", 1)
    return F.struct(key.alias("key"), kind.alias("kind"), ask.alias("ask"), answer.alias("answer"))


def infer_structure(records: DataFrame, record: str, order: str, samples: int = 3) -> DataFrame:
    """key, kind, ask, answer: by the first of `samples` records (by order, as the rule has it) that shows a conversation, else kind 'fallback'."""
    first = records.orderBy(order).limit(samples).select(order, record_structure(F.col(record)).alias("s"))
    best = first.agg(F.min_by("s", F.when(F.col("s.kind").isNotNull(), F.col(order))).alias("s"))
    return best.select("s.key", F.coalesce("s.kind", F.lit("fallback")).alias("kind"), "s.ask", "s.answer")


def with_separator(question: Column, answer: Column, separator: str = "<SEP>", least: int = 0) -> Column:
    """'question SEP answer', or null where both have fewer than `least` characters together or one is empty."""
    q, a = strip(question), strip(answer)
    return F.when((q != "") & (a != "") & (F.length(q) + F.length(a) >= least), F.concat_ws(f" {separator} ", q, a))
