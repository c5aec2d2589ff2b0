"""Rules over questions, answers, dialogues and articles, as column expressions.

Null texts give null (or false where a rule asks for a property of the text).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import quality as Q
from . import text as T

#: Openings and closings that a generating model puts around an article.
OPENINGS = ["claro!", "aqui está", "aqui esta", "claro que sim", "com certeza!", "claro, aqui", "sem problema", "vamos lá", "vamos la"]
CLOSINGS = ["espero que", "posso ajustar", "se precisar", "se quiser", "qualquer coisa", "espero ter", "gostaria de saber se", "caso precise", "se você quiser", "se voce quiser"]
#: Words of either variety of Portuguese.
BRAZIL = ["você", "vocês", "também", "conosco", "a gente", "ônibus", "futebol", "menino", "moleque", "açúcar", "geleia", "sorvete", "banheiro", "celular", "cafezinho", "legal", "muito bom", "beleza", "puxa", "tá", "né", "computador", "geladeira", "torcida", "churrasco", "estádio", "molecada", "café da manhã", "bate-papo", "gente boa", "vamos lá", "de jeito nenhum", "nossa", "uai", "meu deus", "que legal", "bolacha", "coxinha", "pão de queijo"]
PORTUGAL = ["autocarro", "comboio", "telemóvel", "casa de banho", "pequeno-almoço", "frigorífico", "bica", "gajo", "miúdo", "bebé", "candeeiro", "esquentador", "ordenado", "fiambre", "talho", "papelaria", "vós", "connosco", "facto", "óptimo", "acção", "actual", "director", "colecção", "contacto", "projecto", "objecto", "adoptar", "excepção", "reflectir", "correcto", "pá", "bué", "fixe", "berlinde", "autoclismo", "tarjeta", "pisa-papéis", "trambolho", "criado-mudo", "táxi", "tourada", "chávena", "grelhador", "bifana", "croquete", "pregão", "fato de banho", "casa de banho", "caixote do lixo"]
TU_VERBS = ["és", "vais", "tens", "fazes", "viste", "ficaste", "disseste", "foste", "queres", "sabes", "podes", "estás"]
#: Pairs of speaker marks, in order of precedence.
SPEAKERS = [("Pergunta|Perg", "Resposta|Resp"), ("Usu[áa]rio", "Assistente"), ("Pessoa", "Outra")]


def most_common(words: Column) -> Column:
    """How often the most frequent element occurs: one pass over the sorted array."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, x):
        run = F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(words), start, step)["best"]


def over_share(words: Column, share: float) -> Column:
    """Whether one element makes up more than a share of an array: of the sorted elements, two so far apart are equal."""
    far = F.floor(F.size(words) * share).cast("int")
    return Q.once(F.sort_array(words), lambda w: F.exists(F.zip_with(F.slice(w, 1, F.size(w) - far), F.slice(w, far + 1, F.size(w) - far), lambda a, b: a == b), lambda x: x))


def split_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def dialogue_ok(question: Column, answer: Column) -> Column:
    """At least 4 and 10 words, and 6 % distinct words."""
    words = split_words(F.concat_ws(" ", question, answer))
    return (Q.n_words(question) >= 4) & (Q.n_words(answer) >= 10) & (F.size(F.array_distinct(words)) >= 0.06 * F.size(words))


def marked_answer(c: Column) -> Column:
    """What follows the first answer mark, trimmed."""
    return F.trim(F.regexp_extract(c, r"(?s)Resposta:(.*)", 1))


def both_marks(c: Column) -> Column:
    return F.contains(c, F.lit("Pergunta:")) & F.contains(c, F.lit("Resposta:"))


def answer_format(c: Column) -> Column:
    """Whether a marked answer has 8 characters and an end; unmarked text passes."""
    a = marked_answer(c)
    return F.when(~both_marks(c), True).otherwise((F.length(a) >= 8) & ~F.endswith(a, F.lit("...")) & ~F.contains(a, F.lit("��")))


def invalid_reason(c: Column) -> Column:
    """Why a text file is invalid, or null."""
    return (
        F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) < 20, "short")
        .when(F.contains(c, F.lit("Pergunta:")) & ~F.contains(c, F.lit("Resposta:")), "no_answer")
        .when(both_marks(c) & (F.length(marked_answer(c)) < 5), "short_answer")
    )


def dialogue_reason(c: Column, least: int = 8) -> Column:
    """Why a marked dialogue is rejected, or 'ok': marks, turns, words a turn, words in all."""
    plain = F.replace(F.replace(c, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    turns = F.slice(F.split(plain, r"(?:Pessoa|Outra)\s*:"), 2, 1 << 30)
    sizes = F.transform(F.filter(turns, lambda t: F.trim(t) != ""), Q.n_words)
    return (
        F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "empty")
        .when(~F.contains(plain, F.lit("Pessoa:")) | ~F.contains(plain, F.lit("Outra:")), "marks")
        .when(F.regexp_count(plain, F.lit(r"(?i)(?:Pessoa|Outra)\s*:")) < least, "few_turns")
        .when((F.size(sizes) == 0) | (F.array_min(sizes) < 5), "short_turn")
        .when(Q.n_words(plain) < 80, "short")
        .otherwise("ok")
    )


def sentence_keys(c: Column) -> Column:
    """Lookup keys of sentences of more than five words."""
    return F.transform(F.filter(F.split(c, "[.!?]+"), lambda s: Q.n_words(s) > 5), T.lookup_key)


def repeats_itself(c: Column, share: float = 0.3) -> Column:
    """Whether one sentence makes up more than a share of two sentences or more."""
    return Q.once(sentence_keys(c), lambda found: (F.size(found) >= 2) & over_share(found, share))


def bulk_reason(c: Column) -> Column:
    """short, repeated_word (over 40 %), repeated_sentence (three times) or null."""
    words = split_words(c)
    sentences = F.filter(F.transform(F.split(F.replace(F.replace(c, F.lit("! "), F.lit(". ")), F.lit("? "), F.lit(". ")), r"\. "), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.when(F.length(F.coalesce(c, F.lit(""))) < 30, "short").when(most_common(words) > 0.4 * F.size(words), "repeated_word").when(most_common(sentences) >= 3, "repeated_sentence")


def approved(c: Column) -> Column:
    """A judge's verdict, spelling slips allowed; doubt and negation reject."""
    low = F.lower(c)
    return ~low.rlike("suspeit|não aprov|nao aprov") & low.rlike("aprovad|aprovaç")


def variety(c: Column) -> Column:
    """struct(guess, score): Brazilian or European Portuguese by the listed words and verb forms."""
    br = Q.n_phrases(c, BRAZIL)
    pt = sum((F.lower(c).rlike(rf"(?U)\btu {v}\b").cast("int") * 2 for v in TU_VERBS), sum((F.contains(F.lower(c), F.lit(w)).cast("int") for w in PORTUGAL), F.lit(0)))
    guess = F.when((br >= 3) & (br > pt), "br").when((pt >= 3) & (br < pt), "pt").when((pt > 0) & (br == 0), "pt").when((br > 0) & (pt == 0), "br").otherwise("?")
    return F.struct(guess.alias("guess"), (br - pt).alias("score"))


def question_answer(c: Column) -> Column:
    """struct(question, answer) by the first pair of speaker marks found, else cut at the first question mark; null without either."""
    found = []
    for ask, answer in SPEAKERS:
        q = T.clean_contacts(F.regexp_extract(c, rf"(?is)(?:{ask})\s*:\s*(.+?)(?=\s*(?:{answer})\s*:|$)", 1))
        a = T.clean_contacts(F.regexp_extract(c, rf"(?is)(?:{answer})\s*:\s*(.+)", 1))
        found.append(F.when((q != "") & (a != ""), F.struct(q.alias("question"), a.alias("answer"))))
    at = F.instr(c, "?")
    q, a = T.clean_contacts(F.substr(c, F.lit(1), at)), T.clean_contacts(F.substr(c, at + 1))
    found.append(F.when((at > 6) & (F.length(c) - at > 5) & (q != "") & (a != ""), F.struct(q.alias("question"), a.alias("answer"))))
    return F.coalesce(*found)


def blocks(c: Column) -> Column:
    """Blank-line blocks that hold both marks."""
    return F.filter(F.split(c, r"\n\s*\n"), both_marks)


def trimmed_article(c: Column) -> Column:
    """Without leading and trailing lines that are blank or a model's courtesies."""
    rows = F.split(c, r"\r\n|\n|\r")
    body = lambda listed: lambda x: ~F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")).rlike("^$|^(" + "|".join(listed) + ")")
    first = F.array_position(F.transform(rows, body(OPENINGS)), True)
    last = F.size(rows) + 1 - F.array_position(F.reverse(F.transform(rows, body(CLOSINGS))), True)
    kept = F.when((first > 0) & (last >= first) & (last <= F.size(rows)), F.array_join(F.slice(rows, first.cast("int"), (last - first + 1).cast("int")), "\n")).otherwise("")
    return F.regexp_replace(kept, r"^\s+|\s+$", "")


def article_topic(c: Column) -> Column:
    """The first '# ' heading, else null."""
    return F.nullif(F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1), F.lit(""))


def template_number(c: Column, templates: int = 8) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % templates


def fact_sentences(c: Column, pattern: str, most: int = 3) -> Column:
    """The first sentences of 40 to 400 characters that match, no two with the same 80 first characters."""
    hits = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s).between(40, 400) & s.rlike(pattern))
    head = lambda s: F.lower(F.substring(s, 1, 80))
    first = lambda found: Q.once(F.transform(found, head), lambda heads: F.filter(found, lambda s, i: F.array_position(heads, head(s)) == i + 1))
    return F.slice(Q.once(hits, first), 1, most)


def repetitive_ids(ids: Column, pad: int, run: int = 8) -> Column:
    """A chunk of ids that is padding only, has padding before its end, or a run of equal ids."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(False).alias("inner"))

    def step(s, x):
        n = F.when(x.eqNullSafe(s["last"]), s["run"] + 1).otherwise(F.lit(1))
        longest = F.when(x != pad, F.greatest(s["best"], n)).otherwise(s["best"])
        return F.struct(x.cast("long").alias("last"), n.alias("run"), longest.alias("best"), (s["inner"] | ((x != pad) & s["last"].eqNullSafe(F.lit(pad)))).alias("inner"))

    end = F.aggregate(ids, start, step)
    return F.forall(ids, lambda x: x == pad) | end["inner"] | (end["best"] >= run)


def format_of(record: Column) -> Column:
    """Which kind of training record a JSON line is."""
    has = lambda *keys: F.greatest(*[F.get_json_object(record, f"$.{k}").isNotNull() for k in (*keys, "_none")])
    return (
        F.when(has("messages"), "messages").when(has("conversations", "conversation", "chat"), "conversations").when(has("prompt") & has("thought"), "reasoning")
        .when(has("instruction", "prompt") & has("output", "completion", "answer"), "instruction").when(has("pergunta") & has("resposta"), "qna").when(has("text", "content"), "text").otherwise("unknown")
    )


# books


def book_text(c: Column) -> Column:
    """Print marks, page numbers and letter-spaced headers out; the remaining lines joined by a space."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    rows = F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), strip), lambda s: (s != "") & ~s.rlike(r"(?i)sol\.indd|bb\s+preto|^\d{1,2}/\d{1,2}/\d{2,4}$|^www\.|^http") & ~s.rlike(r"(?i)^\d{1,4}\s*$|^[ivxlcdm]{1,4}\s*$"))
    rows = F.filter(rows, lambda s: ~(s.rlike(r"\|[a-zçáéíóúâêôãõ]") & (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) > F.length(s) / 3)))
    rows = F.transform(rows, lambda s: strip(F.regexp_replace(strip(F.regexp_replace(s, r"(?i)[a-zà-úç](?:[ ]+[a-zà-úç]){2,}[^|]*\|[a-zà-úç](?:[ ]+[a-zà-úç])+", " ")), r"\b\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}\b", "")))
    return F.array_join(F.filter(rows, lambda s: s != ""), " ")


def chapters(c: Column) -> Column:
    """Pieces that begin at a line naming a chapter or part."""
    return F.filter(F.split(c, r"(?im)(?=^\s*(?:cap[íi]tulo\s+(?:\d+|[ivxlcdm]+)|(?:\d+|[a-zà-ú]+)\s+parte|parte\s+(?:\d+|[ivxlcdm]+))\b)"), lambda x: F.trim(x) != "")


def theme(c: Column) -> Column:
    """The first sentence of 20 to 90 characters, else the first 80 characters."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(c, r"[.!?]\s+"), lambda s: F.trim(s)), lambda s: F.length(s).between(20, 90)), F.lit(0)), F.trim(F.substring(c, 1, 80)))


def shortened(c: Column, words: int = 500) -> Column:
    """At most so many words, joined by one space."""
    return F.array_join(F.slice(split_words(c), 1, words), " ")


def question_from_title(c: Column) -> Column:
    """A title without its site name as a capitalised question."""
    bare = F.trim(F.regexp_replace(c, r"\s+[—|–-]\s+[^—|–-]*$", ""))
    asked = F.concat(T.upper_letter(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))
    return F.when(F.endswith(asked, F.lit("?")), asked).otherwise(F.concat(asked, F.lit("?")))


def length_class(c: Column) -> Column:
    n = Q.n_words(c)
    return F.when(n < 500, "short").when(n < 1200, "long").otherwise("complete")
