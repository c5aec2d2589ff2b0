"""Rules for generated answers and for topics, as column expressions.

Null texts are rejected as 'empty' (answers) or not accepted (topics).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import quality as Q
from . import rules as R
from . import text as T

#: Whole answers that say nothing.
VAGUE_WHOLE = ["sim", "não", "nao", "talvez", "ok", "claro", "verdade", "mentira", "não sei", "nao sei", "não sei responder", "talvez sim", "talvez não", "depende"]
#: Phrases of weak answers, of generic ones, and of an assistant about itself.
WEAK = ["como ia", "sou uma ia", "não tenho certeza", "não posso", "não sei", "não tenho informação", "a resposta é", "resposta:", "pergunta:", "espero ter ajudado", "qualquer dúvida", "estou aqui para ajudar", "fique à vontade", "precisa de mais alguma coisa"]
EVASIVE = ["depende de vários fatores", "cada caso é um caso", "é importante considerar", "não existe resposta certa", "tudo depende", "é relativo", "não tenho informações suficientes", "não posso afirmar com certeza"]
CRUTCHES = ["como assistente", "sou uma inteligência artificial", "como modelo de linguagem", "não tenho opinião própria", "não tenho sentimentos", "não posso sentir", "sou um programa", "não tenho consciência", "não sou humano", "não possuo emoções", "não tenho crenças"]
#: Patterns of markup, code, links and pictures.
MARKUP = [r"<[^>]+>", r"```[\s\S]*?```", r"`[^`]+`", r"\{.*\}", r"[#*_]{3,}", r"\[.*\]\(.*\)", r"[\x{2600}-\x{27BF}]", r"https?://\S+"]
#: Kinds of text by the number of words that they may have (least, most).
LENGTHS = {"dicionario": (3, 80), "saudacao": (3, 80), "conversa": (40, None), **dict.fromkeys(["pergunta_resposta", "iteracao", "artigo", "conto", "dialogo_profundo", "explicacao", "resumo"], (50, 1000))}
#: Verbs of headlines, and topics that are refused.
HEADLINE_VERBS = "diz dizem afirma afirmam anuncia anunciam revela revelam confirma confirmam critica criticam defende defendem aponta apontam mostra mostram ganha conquista conquistou nega negam pede pedem explica explicam adverte alerta alertam comemora lamenta supera atinge atingiu morre morreu vence venceu manda ordena recorre recorreu classifica classificou oficializa oficializou rejeita rejeitou aprova aprovou lança lançou cria criou investe investiu compra comprou vende vendeu abre abriu fecha fechou inicia iniciou conclui concluiu publica publicou divulga divulgou registra registrou proíbe proibiu autoriza autorizou libera liberou prorroga prorrogou elege elegeu derrota derrotou domina dominou avança avançou cresce cresceu cai caiu sobe subiu centraliza centralizou faz fez recomenda recomendou causa causou aborda abordam discute discutem analisa analisam avalia avaliam prevê antecipa antecipou prepara preparou investiga investigou apresenta apresentam sugere".split()
BLOCKED = ["como fabricar bomba", "como fazer bomba", "receita de droga", "como produzir droga", "como fabricar droga", "metanfetamina", "como cometer suicídio", "como matar alguém", "como sequestrar", "explosivos caseiros", "como hackear", "pedofilia", "violência doméstica"]
#: The second set of lengths, and of instructions by kind and questions by topic.
LENGTHS_LONG = {
    "dicionario": (8, 100), "resumo": (60, 400), "conversa": (100, None), "poema": (30, 200), "carta": (80, 500), "receita": (50, 300), "dica": (30, 150),
    **dict.fromkeys(["pergunta_resposta", "artigo", "conto", "dialogo_profundo", "explicacao", "entrevista", "debate", "tutorial", "resenha", "relatorio", "ensaio"], (120, 1200)),
}
INSTRUCTIONS = {
    "pergunta_resposta": "Responda à pergunta sobre {t}.", "dicionario": "Explique o significado de {t}.", "iteracao": "Explique {t} em detalhes.", "artigo": "Escreva um artigo informativo e completo sobre {t}.",
    "conto": "Escreva um conto envolvente sobre {t}.", "dialogo_profundo": "Tenha uma conversa profunda sobre {t}.", "explicacao": "Explique o conceito de {t} com clareza.", "resumo": "Resuma o tema {t} de forma objetiva.",
    "poema": "Escreva um poema sobre {t}.", "carta": "Escreva uma carta sobre {t}.", "entrevista": "Conduza uma entrevista sobre {t}.", "debate": "Promova um debate sobre {t}.", "tutorial": "Escreva um tutorial sobre {t}.",
    "resenha": "Escreva uma resenha sobre {t}.", "relatorio": "Escreva um relatório sobre {t}.", "ensaio": "Escreva um ensaio sobre {t}.", "cronica": "Escreva uma crônica sobre {t}.", "receita": "Escreva uma receita de {t}.",
    "dica": "Dê dicas sobre {t}.", "conversa": "Converse naturalmente sobre {t}.",
}
QUESTIONS = ["Fale sobre {t}", "Explique {t}", "O que você sabe sobre {t}?", "Conte-me sobre {t}", "Qual a importância de {t}?", "Como funciona {t}?", "Qual a origem de {t}?"]
QUESTION_STARTS = ["o que ", "quem ", "como ", "por que ", "onde ", "quando "]
LIST_LINE = r"^([-*•]\s+|\d+[.)]\s+)"


def any_phrase(c: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases occurs; one literal search each, until one is found."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(c, F.lit(p))
    return found


def list_share(c: Column) -> Column:
    """Share of the lines with text that are items of a list."""
    return Q.once(Q.lines(c), lambda found: F.when(F.size(found) == 0, 0.0).otherwise(F.size(F.filter(found, lambda x: x.rlike(LIST_LINE))) / F.size(found)))


def has_markup(c: Column) -> Column:
    """Whether one of the patterns occurs."""
    return c.rlike("(?is)" + "|".join(MARKUP))


def answer_reason(c: Column, kind: str = "artigo", finish: Column | None = None, long: bool = False) -> Column:
    """Why a generated text is rejected, the first rule that holds, or 'ok'. finish: why the generation ended. long: the second set of rules, with repeated sentences and other lengths."""
    least, most = (LENGTHS_LONG if long else LENGTHS).get(kind, (None, None))

    def of_text(text: Column) -> Column:
        cut = F.endswith(text, F.lit("...")) | (F.length(text) < 5)
        if finish is not None:
            cut = cut | F.coalesce(finish.isin("length", "max_tokens"), F.lit(False))
        return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(cut, "truncated").otherwise(Q.once(T.lookup_key(text), lambda key: of_key(text, key)))

    def of_key(text: Column, key: Column) -> Column:
        out = (
            F.when(key.isin(VAGUE_WHOLE), "vague").when(any_phrase(key, WEAK), "weak").when(F.contains(text, F.lit("��")), "strange").when(has_markup(text), "markup")
            .when(list_share(text) > 0.5, "list").when(Q.once(R.split_words(text), lambda w: (F.size(w) >= 10) & R.over_share(w, 0.4)), "repeated")
        )
        low = Q.once(F.lower(text), lambda low: F.when(any_phrase(low, EVASIVE), "generic").when(any_phrase(low, CRUTCHES), "crutch"))
        return F.coalesce(out, low, of_length(text, key))

    def of_length(text: Column, key: Column) -> Column:
        out = F.when(R.repeats_itself(text), "repeated_sentences") if long else F.when(F.lit(False), "")
        limits = Q.once(F.regexp_count(key, F.lit(r"\S+")), lambda n: F.when(n < (least or 0), "short").when(n > (most or (1 << 30)), "long").otherwise("ok"))
        return F.coalesce(out, limits)

    return Q.once(T.clean_contacts(c), of_text)


def safe_topic(c: Column) -> Column:
    return ~any_phrase(F.lower(c), BLOCKED)


def topic(c: Column, longest: int = 90) -> Column:
    """The line, trimmed, if it can stand as a topic, else null: not a headline, a question or a quotation."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    low, words = F.lower(t), R.split_words(t)
    first = F.substring(t, 1, 1)
    verb = F.exists(F.slice(words, 2, 6), lambda w: F.regexp_replace(F.lower(w), "^[.,:;()]+|[.,:;()]+$", "").isin(HEADLINE_VERBS))
    headline = (F.size(words) >= 3) & first.rlike(r"^\p{Lu}") & verb
    start = F.lit(False)
    for s in QUESTION_STARTS:
        start = start | F.startswith(low, F.lit(s))
    bad = (
        (F.length(t) > longest) | t.rlike("['\"“”‘«:;]") & t.rlike("^[‘«]|['\"“”:;]") | F.contains(t, F.lit(" - ")) | start | first.rlike("^[0-9]") | F.endswith(t, F.lit("?"))
        | (F.size(words) < 2) | F.contains(low, F.lit(", segundo")) | headline
    )
    return F.when((t != "") & ~bad, t)


def instruction(kind: Column, theme: Column) -> Column:
    """What a user would have asked for a text of a kind on a theme; 'este tema' stands for none."""
    table = F.create_map(*[F.lit(x) for pair in INSTRUCTIONS.items() for x in pair])
    pattern = F.coalesce(F.try_element_at(table, kind), F.lit("Fale sobre {t}."))
    return F.replace(pattern, F.lit("{t}"), F.coalesce(F.nullif(theme, F.lit("")), F.lit("este tema")))


def topic_question(subject: Column, number: Column) -> Column:
    """The question of a number (from 0, modulo the number of questions) on a topic, whose article at the front is lowered, with one question mark."""
    lowered = F.when(subject.rlike(r"(?i)^(a|o|as|os|uma|um)\s+\S"), F.concat(F.lower(F.regexp_extract(subject, r"^(\S+)", 1)), F.lit(" "), F.regexp_replace(subject, r"^\S+\s+", ""))).otherwise(subject)
    pattern = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.pmod(number, F.lit(len(QUESTIONS))) + 1).cast("int"))
    asked = F.trim(F.replace(pattern, F.lit("{t}"), lowered))
    return F.when(F.endswith(asked, F.lit("?")), asked).otherwise(F.concat(asked, F.lit("?")))


def marked_pair(c: Column) -> Column:
    """struct(question, answer) by the marks alone: what stands between the first two, what follows the first answer mark, else the whole text as the answer."""
    text = F.coalesce(c, F.lit(""))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    after = F.when(F.contains(text, F.lit("Resposta:")), F.regexp_extract(text, r"(?s)Resposta:(.*)", 1)).otherwise(text)
    between = F.when(R.both_marks(text), F.substring_index(F.regexp_extract(text, r"(?s)Pergunta:(.*)", 1), "Resposta:", 1)).otherwise("")
    return F.struct(strip(between).alias("question"), strip(after).alias("answer"))
