"""Predicates and scorers over texts, as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a generating model says about its own task.
NOISE = [
    r"the\s+user\s+gave\s+instructions", r"we\s+need\s+to\s+output\s+the\s+article", r"final\s+answer\s+should\s+be\s+the\s+article",
    r"let'?s\s+craft\s+an?\s+article", r"let'?s\s+produce\s+the\s+article", r"write\s+an\s+article\s+of\s+high\s+quality",
    r"write\s+a\s+long\s+consistent\s+text", r"no\s+extra\s+commentary\s+outside\s+article", r"there'?s\s+no\s+further\s+conversation",
    r"so\s+we\s+need\s+to\s+output", r"the\s+conversation\s*:\s*system\s+gave", r"we\s+need\s+a\s+long\s+consistent\s+text",
    r"opening\s+situates\s+reader", r"portuguese\s+brazilian\s+natural", r"produce\s+the\s+article\s+as\s+per\s+format",
    r"no\s+extra\s+observations", r"answer\s*:\s*they\s+asked\s+to\s+write", r"system\s+gave\s+instructions\s+to\s+write",
    r"let'?s\s+write\s+an\s+article", r"i'?ll\s+write\s+an\s+article", r"here'?s\s+an\s+article",
    r"as\s+an\s+ai\s+(language\s+model|assistant)", r"i\s+am\s+an\s+ai\s+(language\s+model|assistant)", r"i\s+can'?t\s+(access|browse|fetch)",
    r"i\s+don'?t\s+have\s+(access|information|the\s+ability)", r"my\s+knowledge\s+cutoff", r"as\s+a\s+large\s+language\s+model",
    r"o\s+usu[áa]rio\s+deu\s+instru[çc][õo]es", r"precisamos\s+gerar\s+o\s+artigo", r"a\s+resposta\s+final\s+deve\s+ser\s+o\s+artigo",
    r"vamos\s+criar\s+um\s+artigo", r"escreva\s+um\s+artigo\s+de\s+alta\s+qualidade", r"sem\s+coment[áa]rios\s+extras", r"n[ãa]o\s+h[áa]\s+mais\s+conversa",
]
#: Stop words by language.
STOPWORDS = {
    "pt": "o a os as de do da dos das um uma uns umas e ou que não é são foi ser em para por com sem sob sobre entre depois antes como mais menos muito também já ainda assim então porque isso aquilo este esta esses essas seu sua seus suas nosso nossa eu tu ele ela nós vós eles elas me te se lhe nos vos lo la lhe lhes ao à às aos no na nos nas num numa".split(),
    "en": "the a an of to in and or is are was were be been for with without by on at from as than then also very much more less this that these those its their our your my his her it he she they we you not no yes so because if but when while after before between over under about into onto up down out off".split(),
}
#: Phrases of a loose style.
MARKERS = ["é como se estivessem dizendo", "é como se estivesse dizendo", "olha só", "olha lá", "vamos tentar descobrir", "eu sou incrível", "eu sou melhor agora", "eu entendi", "não sabe o que isso significa"]
#: Phrases of an answer that says nothing.
VAGUE = [
    "envolve diversos aspectos importantes", "contexto histórico e social", "implicações práticas são significativas", "é essencial refletir sobre", "afeta o dia a dia das pessoas",
    "tema .* é muito relevante", "em primeiro lugar, devemos considerar", "em segundo lugar", "por fim, é essencial", "não tenho informações suficientes",
]
#: Phrases of a model about itself, and of generic answers.
ESCAPES = ["sou um modelo de linguagem", "sou uma ia", "sou um programa", "não tenho sentimentos", "como assistente", "como uma ia", "enquanto ia", "não sou humano", "não posso sentir"]
GENERIC = ["depende", "cada caso é um caso", "é muito relevante", "varia de pessoa para pessoa", "depende do contexto", "depende de cada", "tudo depende", "na minha opinião tudo é relativo"]
SYMBOLS = "#*_<>{}[]|~^`\\"
LETTERS = "[a-záéíóúâêôãõàüçñ]+"


def once(c: Column, fn) -> Column:
    """fn(c) where c is computed once, however often fn names it: branches of a CASE or OR would each compute it anew."""
    return F.transform(F.array(c), fn)[0]


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def n_sentences(c: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"[.!?…](\s|$)")))


def lines(c: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")  # F.trim itself takes the place as a second argument: characters to trim


def dup_line_ratio(c: Column) -> Column:
    def share(found: Column) -> Column:
        n = F.size(found)
        return F.when(n <= 1, F.lit(0.0)).otherwise((n - F.size(F.array_distinct(found))) / n)

    return once(lines(c), share)


def symbol_ratio(c: Column) -> Column:
    n = F.length(c)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.translate(c, SYMBOLS, ""))) / n)


def literal_of(pattern: str) -> str:
    """The longest run of letters and spaces that every match of a pattern holds, with a space for white space: classes, groups and optional parts cut runs."""
    plain = re.sub(r"\[[^\]]*\]|\([^)]*\)|\\s\*|.\?", "\0", pattern.replace(r"\s+", " "))
    return max(re.findall("[a-z ]+", plain), key=len)


def ai_noise(c: Column) -> Column:
    """Whether one of the phrases is in the first 3000 characters; the patterns are only tried where a literal part of one occurs."""

    def noisy(head: Column) -> Column:
        def some(plain: Column) -> Column:
            return reduce(or_, (F.contains(plain, F.lit(literal_of(p))) for p in NOISE))

        return F.when(once(F.regexp_replace(head, r"\s+", " "), some), head.rlike("|".join(NOISE))).otherwise(F.when(head.isNotNull(), F.lit(False)))

    return once(F.lower(F.substring(c, 1, 3000)), noisy)


def quality_reason(c: Column) -> Column:
    """Why a text is rejected, or null: the first rule that holds."""
    return (
        F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "empty").when(n_words(c) < 20, "short").when(dup_line_ratio(c) > 0.3, "repeated_lines").when(symbol_ratio(c) > 0.1, "symbols")
    )


def tokens(c: Column, pattern: str = LETTERS) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def stopword_count(words: Column, lang: str) -> Column:
    listed = F.array(*[F.lit(w) for w in sorted(set(STOPWORDS[lang]))])
    return F.size(F.filter(words, lambda w: F.array_contains(listed, w)))


def ttr(c: Column) -> Column:
    words = tokens(c)
    return F.when(F.size(words) < 30, F.lit(0.0)).otherwise(F.size(F.array_distinct(words)) / F.size(words))


def repetition(words: Column) -> Column:
    """struct(words, adjacent, distinct, bigrams, repeated_bigrams) of an array of words.

    The words and the pairs are found once.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        rest = F.greatest(n - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def counts(p: Column) -> Column:
            return F.struct(
                n.alias("words"), F.size(F.filter(p, lambda x: x["a"] == x["b"])).alias("adjacent"), F.size(F.array_distinct(w)).alias("distinct"),
                F.size(p).alias("bigrams"), (F.size(p) - F.size(F.array_distinct(F.transform(p, lambda x: F.concat_ws(" ", x["a"], x["b"]))))).alias("repeated_bigrams"),
            )

        return once(pairs, counts)

    return F.when(words.isNotNull(), once(words, of))


def cut_lines(c: Column) -> Column:
    """Number of lines that end in a fragment of three letters or more, where the next line's first word is longer and begins with it."""
    found = F.split(F.regexp_replace(c, r"\r\n", "\n"), r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
    low = F.transform(found, F.lower)
    tails = F.transform(low, lambda x: F.regexp_extract(x, r"([a-záéíóúâêôãõàüçñ]{3,})[\s\x1C-\x1F]*\z", 1))
    heads = F.transform(low, lambda x: F.regexp_extract(x, LETTERS, 0))
    last = F.size(found) - 1
    both = F.zip_with(F.slice(tails, 1, F.greatest(last, F.lit(0))), F.slice(heads, 2, F.greatest(last, F.lit(0))), lambda a, b: (a != "") & (F.length(b) > F.length(a)) & F.startswith(b, a))
    return F.coalesce(F.size(F.filter(both, lambda x: x)), F.lit(0))


def repetition_points(m: Column, markers: Column, cut: Column) -> Column:
    """Penalty points: more is worse."""
    n = F.greatest(m["words"], F.lit(1))
    points = F.when(m["adjacent"] / n >= 0.03, 2).when(m["adjacent"] > 0, 1).otherwise(0)
    points += F.when(cut >= 3, 2).when(cut > 0, 1).otherwise(0)
    points += F.when(m["distinct"] / n < 0.4, 1).otherwise(0)
    points += F.when(m["repeated_bigrams"] / F.greatest(m["bigrams"], F.lit(1)) >= 0.1, 1).otherwise(0)
    points += F.when(markers >= 3, 1).otherwise(0) + F.when(m["words"] < 30, 1).otherwise(0)
    return points + F.when((m["adjacent"] / n >= 0.03) & (cut >= 3), 1).otherwise(0)


def repetition_class(points: Column) -> Column:
    return F.when(points >= 5, "trash").when(points >= 2, "suspect").otherwise("approved")


def n_phrases(c: Column, phrases: list[str]) -> Column:
    low = F.lower(c)
    return sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def vague_answer(c: Column) -> Column:
    low = F.lower(c)
    return low.rlike("|".join(VAGUE)) | ((n_words(c) < 30) & ~F.contains(c, F.lit("?")) & ~F.contains(c, F.lit("!")))


def truncated(c: Column, least: int = 60) -> Column:
    t = F.trim(c)
    return (F.length(t) < least) | ~t.rlike("[.!?…\"'”)]$") | F.endswith(t, F.lit("...")) | F.contains(t, F.lit("�"))


def response_score(c: Column, least: int = 60) -> Column:
    """0 to 10: a closing question with two options adds, escapes, generic phrases and truncation take off; without the question at most 3."""
    last = F.lower(F.element_at(F.split(F.trim(c), r"(?<=[.!?])\s+"), -1))
    rule = F.endswith(last, F.lit("?")) & last.rlike(" ou |prefere|opções|opcoes|gostaria de saber|quer saber|preferiria")
    score = F.lit(5.0) + F.when(rule, 3.0).otherwise(0.0) - F.when(n_phrases(c, ESCAPES) > 0, 2.0).otherwise(0.0)
    score = score - F.when(n_phrases(c, GENERIC) > 0, 3.0).otherwise(0.0) - F.when(truncated(c, least), 4.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.when(rule, score).otherwise(F.least(score, F.lit(3.0)))))


def site_score(c: Column, title: Column, lang: Column) -> Column:
    """0 to 100 by length, title, language and sentence length."""
    n = n_words(c)
    score = F.when(n >= 500, 40).when(n >= 200, 30).when(n >= 100, 20).when(n >= 40, 10).otherwise(0)
    score += F.when(F.coalesce(title, F.lit("")) != "", 15).otherwise(0) + F.when(lang == "pt", 25).when(lang == "en", 10).otherwise(0)
    score -= F.when((n > 0) & (n / n_sentences(c) > 200), 20).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def words_a_sentence(c: Column) -> Column:
    return F.round(n_words(c) / n_sentences(c), 1)


def blacklisted(c: Column, listed: list[str], limit: int = 200) -> Column:
    """Whether a text holds at least `limit` of the distinct listed phrases (substrings, in lower case)."""
    low = F.lower(c)
    phrases = F.array(*[F.lit(w) for w in sorted({w.lower() for w in listed if w})]) if listed else F.array().cast("array<string>")
    return F.size(F.filter(phrases, lambda w: F.contains(low, w))) >= limit


def request_cost(tokens: Column, price_in: float, price_out: float, answered: Column | None = None) -> Column:
    """Price of a request, by prices a million tokens; an unknown answer counts as 30 % of the request."""
    out = F.coalesce(answered, F.floor(tokens * 0.3)) if answered is not None else F.floor(tokens * 0.3)
    return F.round(tokens / 1e6 * price_in + out / 1e6 * price_out, 8)


def digests(prompt: Column, answer: Column) -> Column:
    """struct: md5 of the trimmed lower-case prompt, md5 of both sides, and 16 digits of an md5 of both sides for file names."""
    return F.struct(F.md5(F.lower(F.trim(prompt))).alias("prompt"), F.md5(F.concat(prompt, F.lit("\x01"), answer)).alias("both"), F.substring(F.md5(F.concat(prompt, F.lit("|"), answer)), 1, 16).alias("short"))
