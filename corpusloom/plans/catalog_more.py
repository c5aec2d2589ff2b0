"""Queries over generated-text rules, page extraction, pair parsing, lookups and resumable sinks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generated as G
from ..functions import pages as H
from ..functions import quality as Q
from ..functions import text as T
from ..operators import conversation as C
from ..operators import dedup as D
from ..operators import lookups as L
from ..operators import pairs as P
from ..operators.ranking import best
from ..sources import corpora, sinks
from ..streaming import pickup
from .catalog import WORDS, query
from .catalog_records import CONTACTS, PAIRS, job, pair_texts
from .light_clean import chain_clean, light_clean_full


def ID():  # noqa: N802
    return F.col("doc_id")


def X():  # noqa: N802
    return F.col("text")


def _any(column, phrases):
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


# generated texts and topics

CLEAN = CONTACTS.format("text")
KEY = "trim(regexp_replace(regexp_replace(lower(trim(c)), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', ' ', 'g'))"
ITEMS = "list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
MOST = "coalesce(list_max(map_values(list_aggregate(regexp_extract_all(c, '\\S+'), 'histogram'))), 0)"


SENTENCE_KEYS = "list_transform(list_filter(string_split_regex(c, '[.!?]+'), lambda s: len(regexp_extract_all(s, '\\S+')) > 5), lambda s: trim(regexp_replace(regexp_replace(lower(trim(s)), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', ' ', 'g')))"


def answer_sql(ids: str, rows: str, least: int, most: int, long: bool = False) -> str:
    again = f"WHEN len({SENTENCE_KEYS}) >= 2 AND coalesce(list_max(map_values(list_aggregate({SENTENCE_KEYS}, 'histogram'))), 0) > 0.3 * len({SENTENCE_KEYS}) THEN 'repeated_sentences'" if long else ""
    return f"""WITH s AS (SELECT {ids}, {CLEAN} AS c FROM {rows}), k AS (SELECT *, {KEY} AS k FROM s)
SELECT {ids}, CASE WHEN c = '' THEN 'empty' WHEN ends_with(c, '...') OR length(c) < 5 THEN 'truncated'
 WHEN k IN ({", ".join(f"'{v}'" for v in G.VAGUE_WHOLE)}) THEN 'vague' WHEN {_any("k", G.WEAK)} THEN 'weak' WHEN contains(c, '��') THEN 'strange'
 WHEN {" OR ".join(f"regexp_matches(c, '(?is){p}')" for p in G.MARKUP)} THEN 'markup'
 WHEN len({ITEMS}) > 0 AND len(list_filter({ITEMS}, lambda x: regexp_matches(x, '{G.LIST_LINE}'))) / len({ITEMS}) > 0.5 THEN 'list'
 WHEN len(regexp_extract_all(c, '\\S+')) >= 10 AND {MOST} > 0.4 * len(regexp_extract_all(c, '\\S+')) THEN 'repeated'
 WHEN {_any("lower(c)", G.EVASIVE)} THEN 'generic' WHEN {_any("lower(c)", G.CRUTCHES)} THEN 'crutch' {again}
 WHEN len(regexp_extract_all(k, '\\S+')) < {least} THEN 'short' WHEN len(regexp_extract_all(k, '\\S+')) > {most} THEN 'long' ELSE 'ok' END AS reason FROM k"""


@query("answer_reason", "documents", heavy=True, sql=answer_sql("doc_id", "documents", 50, 1000))
def _(docs):
    return docs.select(ID(), G.answer_reason(X(), "artigo").alias("reason"))


@query("turn_reason", "conversations", sql=answer_sql("conv_id, turn", "conversations", 3, 80))
def _(turns):
    return turns.select("conv_id", "turn", G.answer_reason(X(), "dicionario").alias("reason"))


@query("answer_reason_long", "documents", heavy=True, sql=answer_sql("doc_id", "documents", 120, 1200, True))
def _(docs):
    return docs.select(ID(), G.answer_reason(X(), "artigo", long=True).alias("reason"))


@query("instructions", "documents", sql="SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Escreva uma receita de ' || lang || '.' WHEN 1 THEN 'Explique ' || lang || ' em detalhes.' ELSE 'Fale sobre este tema.' END AS instruction FROM documents")
def _(docs):
    kind = F.element_at(F.array(F.lit("receita"), F.lit("iteracao"), F.lit("none")), (ID() % 3 + 1).cast("int"))
    return docs.select(ID(), G.instruction(kind, F.when(ID() % 3 < 2, F.col("lang"))).alias("instruction"))


@query("topic_questions", "documents", sql="WITH t AS (SELECT doc_id, regexp_extract(text, '^[^.!?\\n]{1,60}') AS s FROM documents), l AS (SELECT doc_id, CASE WHEN regexp_matches(s, '(?i)^(a|o|as|os|uma|um)\\s+\\S') THEN lower(regexp_extract(s, '^(\\S+)', 1)) || ' ' || regexp_replace(s, '^\\S+\\s+', '') ELSE s END AS s FROM t), q AS (SELECT doc_id, trim(replace([" + ", ".join(f"'{q}'" for q in G.QUESTIONS) + "][CAST(doc_id % 7 + 1 AS INT)], '{t}', s)) AS q FROM l) SELECT doc_id, CASE WHEN ends_with(q, '?') THEN q ELSE q || '?' END AS question FROM q")
def _(docs):
    return docs.select(ID(), G.topic_question(F.regexp_extract(X(), r"^[^.!?\n]{1,60}", 0), ID()).alias("question"))


@query("marked_pairs", "conversations", sql=f"WITH {PAIRS}, m AS (SELECT conv_id, turn, trim(regexp_replace(string_split(text[instr(text, 'Pergunta:') + 9:], 'Resposta:')[1], '^\\s+|\\s+$', '', 'g')) AS q, regexp_replace(text[instr(text, 'Resposta:') + 9:], '^\\s+|\\s+$', '', 'g') AS a FROM t) SELECT conv_id, turn, md5(q) AS q, md5(a) AS a FROM m")
def _(turns):
    found = pair_texts(turns).select("conv_id", "turn", G.marked_pair(X()).alias("p"))
    return found.select("conv_id", "turn", F.md5("p.question").alias("q"), F.md5("p.answer").alias("a"))


@query("recent_keys", "events", sql="WITH p AS (SELECT event_id, event_type, user_id % 20 AS g, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k FROM events) SELECT event_id, coalesce(k - lag(k) OVER (PARTITION BY g, event_type ORDER BY event_id) <= 4, false) AS seen FROM p")
def _(events):
    return D.recent_duplicates(events.withColumn("g", F.col("user_id") % 20), "g", "event_id", "event_type", 4).select("event_id", "seen")


VERBS = "[" + ", ".join(f"'{v}'" for v in G.HEADLINE_VERBS) + "]"
TOPIC = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM l),
 w AS (SELECT *, regexp_extract_all(t, '\\S+') AS w FROM t)
SELECT doc_id, md5(t) AS topic, count(*) AS n FROM w WHERE t <> '' AND length(t) <= 90 AND NOT regexp_matches(t, '^[‘«]|[''"“”:;]') AND NOT contains(t, ' - ') AND NOT ends_with(t, '?')
 AND NOT regexp_matches(lower(t), '^(o que |quem |como |por que |onde |quando )') AND NOT regexp_matches(t, '^[0-9]') AND len(w) >= 2 AND NOT contains(lower(t), ', segundo')
 AND NOT (len(w) >= 3 AND regexp_matches(t, '^\\p{{Lu}}') AND len(list_filter(w[2:7], lambda x: list_contains({VERBS}, regexp_replace(lower(x), '^[.,:;()]+|[.,:;()]+$', '', 'g')))) > 0)
 AND NOT {_any("lower(t)", G.BLOCKED)} GROUP BY 1, 2"""


@query("topics", "documents", sql=TOPIC)
def _(docs):
    lines = docs.select(ID(), F.explode(F.split(X(), "\n")).alias("line")).select(ID(), G.topic(F.col("line")).alias("t"))
    return lines.filter(F.col("t").isNotNull() & G.safe_topic(F.col("t"))).groupBy(ID(), F.md5("t").alias("topic")).agg(F.count("*").alias("n"))


# texts


def _spaced(c):
    c = f"regexp_replace({c}, '([a-záéíóúàèìòùâêîôûäëïöü])([A-ZÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ])', '\\1 \\2', 'g')"
    for w in T.INFIXES:
        c = f"regexp_replace({c}, '(?i)([a-záéíóú])({w})([a-záéíóú])', '\\1 \\2 \\3', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("insert_spaces", "documents", heavy=True, sql=f"SELECT doc_id, md5({_spaced('text')}) AS h FROM documents")
def _(docs):
    return docs.select(ID(), F.md5(T.insert_spaces(X())).alias("h"))


@query("without_contents", "documents")
def _(docs):
    return docs.select(ID(), F.md5(T.without_contents_column(X())).alias("h"))


@query("rejoined_lines", "documents")
def _(docs):
    return docs.select(ID(), F.md5(T.rejoin_cut_column(X())).alias("h"))


@query("chain_clean", "documents", heavy=True)
def _(docs):
    done = chain_clean(docs.select(ID(), "text"))
    return done.select(ID(), F.md5("text").alias("h"), "flags.*")


@query("entities", "pages", sql="SELECT page_id, md5(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&')) AS h FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages) WHERE NOT regexp_matches(regexp_replace(t, '&(copy|middot|nbsp|amp);', '', 'g'), '&[A-Za-z0-9#]+;') AND NOT regexp_matches(t, '&amp;[A-Za-z0-9#]+;')")
def _(pages):
    bare = pages.select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("t"))
    usual = ~F.regexp_replace("t", "&(copy|middot|nbsp|amp);", "").rlike("&[A-Za-z0-9#]+;") & ~F.col("t").rlike("&amp;[A-Za-z0-9#]+;")
    return bare.filter(usual).select("page_id", F.md5(T.decode_entities(F.col("t"))).alias("h"))


@query("page_articles", "pages")
def _(pages):
    c = F.col("html")
    return pages.select("page_id", F.md5(H.article_column(c)).alias("article"), F.md5(H.page_column(c)).alias("content"), F.md5(H.encyclopedia_column(c)).alias("encyclopedia"))


# pairs

TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("serialised_prompt", "conversations", sql=f"SELECT conv_id, md5({TRIM.format('string_agg(' + TRIM.format('text') + ', chr(32) ORDER BY turn)')}) AS h FROM conversations WHERE role IN ('user', 'system') AND text <> '' GROUP BY conv_id")
def _(turns):
    prompt = C.messages(turns).select("conv_id", F.to_json("messages").alias("p"), F.exists("messages", lambda m: m["role"].isin("user", "system") & (m["content"] != "")).alias("any"))
    return prompt.filter("any").select("conv_id", F.md5(P.serialised_prompt(F.col("p"))).alias("h"))


@query("line_pairs", "conversations", sql=f"WITH {PAIRS}, c AS (SELECT conv_id, turn, {TRIM.format('q')} AS q, {TRIM.format('a')} AS a FROM t) SELECT conv_id, turn, 1 AS n, md5(regexp_replace(q, '[ \\t]*(\\r\\n|\\n|\\r)[ \\t]*', ' ', 'g')) AS q, md5(regexp_replace(a, '[ \\t]*(\\r\\n|\\n|\\r)[ \\t]*', ' ', 'g')) AS a FROM c WHERE NOT regexp_matches(q || chr(10) || a, '(?i)(pergunta|resposta|user|humano|usu[áa]rio|assistente|bot|gpt|model|\\b[pqhra])\\s*[:：]')")
def _(turns):
    texts = pair_texts(turns).filter(~F.concat_ws("\n", "question", "answer").rlike(r"(?iu)(pergunta|resposta|user|humano|usu[áa]rio|assistente|bot|gpt|model|\b[pqhra])\s*[:：]"))
    found = texts.select("conv_id", "turn", P.line_pairs(X()).alias("p"))
    return found.select("conv_id", "turn", F.size("p").alias("n"), F.md5(F.col("p")[0]["question"]).alias("q"), F.md5(F.col("p")[0]["answer"]).alias("a"))


@query("block_pairs", "conversations", sql=f"WITH {PAIRS}, b AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(unnest(string_split({TRIM.format('text')}, chr(10) || chr(10))), '^\\s+|\\s+$', '', 'g'), chr(10)), lambda x: starts_with(x, 'Pergunta:') OR starts_with(x, 'Resposta:')) AS l FROM t), m AS (SELECT conv_id, turn, {TRIM.format("replace(list_filter(l, lambda x: starts_with(x, 'Pergunta:'))[-1], 'Pergunta:', '')")} AS q, {TRIM.format("replace(list_filter(l, lambda x: starts_with(x, 'Resposta:'))[-1], 'Resposta:', '')")} AS a FROM b) SELECT conv_id, turn, md5(q) AS q, md5(a) AS a FROM m WHERE q <> '' AND a <> ''")
def _(turns):
    found = pair_texts(turns).select("conv_id", "turn", F.explode(P.block_pairs(X())).alias("p"))
    return found.select("conv_id", "turn", F.md5("p.question").alias("q"), F.md5("p.answer").alias("a"))


@query("separated_text", "conversations", sql=f"WITH {PAIRS} SELECT conv_id, turn, md5({TRIM.format('q')} || ' <SEP> ' || {TRIM.format('a')}) AS h FROM t WHERE length({TRIM.format('q')}) + length({TRIM.format('a')}) >= 40")
def _(turns):
    made = C.adjacent_pairs(turns).select("conv_id", "turn", P.with_separator(F.col("question"), F.col("answer"), least=40).alias("t"))
    return made.filter("t is not null").select("conv_id", "turn", F.md5("t").alias("h"))


@query("record_structure", "conversations", sql="SELECT conv_id, 'conversations' AS key, 'turns' AS kind, CASE WHEN bool_or(role = 'user') FILTER (k <= 10) THEN 'user' ELSE 'user' END AS ask, 'assistant' AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id")
def _(turns):
    record = C.messages(turns).select("conv_id", F.to_json(F.struct(F.col("messages").alias("conversations"))).alias("r"))
    found = record.select("conv_id", P.record_structure(F.col("r")).alias("s"))
    return found.select("conv_id", "s.key", "s.kind", F.array_join("s.ask", ",").alias("ask"), F.array_join("s.answer", ",").alias("answer"))


# lookups and reports

TERMS = [("motion", "run"), ("motion", "walk"), ("motion", "movement"), ("grammar", "the"), ("grammar", "and"), ("grammar", "tion"), ("romance", "que"), ("romance", "ment"), ("romance", "ción"), ("german", "und"), ("german", "sch"), ("german", "keit")]


@query("category_terms", "documents", sql="WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {k}, '{w}')" for k, (c, w) in enumerate(TERMS)) + ") v(category, rank, term)), h AS (SELECT doc_id, category, arg_min(term, rank) AS item, count(*) AS hits FROM documents, t WHERE CASE WHEN length(term) < 4 THEN contains(' ' || lower(text) || ' ', ' ' || term || ' ') ELSE contains(lower(text), term) END GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, category) AS place FROM h) SELECT doc_id, category, item, hits, CAST(place AS INT) AS place FROM r WHERE place <= 3")
def _(docs):
    terms = docs.sparkSession.createDataFrame([(c, k, w) for k, (c, w) in enumerate(TERMS)], "category string, rank int, term string")
    return L.category_hits(docs, terms).withColumnRenamed("id", "doc_id")


@query("known_context", "documents", "labels", sql="WITH b AS (SELECT lang, max(source) AS source FROM documents GROUP BY lang) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'about ' || lang ELSE '' END AS context, CASE WHEN doc_id % 2 = 0 THEN b.source ELSE '' END AS source FROM documents JOIN b USING (lang)")
def _(docs, labels):
    base = docs.groupBy("lang").agg(F.max("source").alias("source")).select(F.concat(F.lit(" "), F.upper("lang")).alias("topic"), F.concat(F.lit("about "), "lang").alias("context"), "source")
    rows = docs.select(ID(), F.when(F.col("doc_id") % 2 == 0, F.initcap("lang")).otherwise("none").alias("asked"))
    return L.known_context(rows, base, "asked").select(ID(), "context", "source")


@query("verified_claims", "benchmark", "documents", sql="WITH c AS (SELECT item_id, list_transform(regexp_extract_all(text, '\\S+')[1:4], lambda x: lower(x)) AS t FROM benchmark), r AS (SELECT doc_id, source, lower(source || ' ' || text) AS blob FROM documents), h AS (SELECT item_id, t, doc_id, source, len(list_filter(t, lambda x: contains(blob, x))) AS hits FROM c JOIN r ON r.doc_id % 400 = item_id), b AS (SELECT item_id AS claim_id, any_value(t) AS t, max(hits) AS hits FROM h GROUP BY 1) SELECT claim_id, CASE WHEN hits >= greatest(2, len(t) // 2) THEN 'confirmed' ELSE 'not_found' END AS verdict, CAST(hits AS INT) AS hits FROM b")
def _(items, docs):
    claims = items.select(F.col("item_id").alias("claim_id"), F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("terms"))
    results = docs.select((F.col("doc_id") % 400).alias("claim_id"), "source", F.col("source").alias("title"), "text")
    return L.verified_claims(claims, results).filter("verdict <> 'no_search'").select("claim_id", "verdict", F.col("hits").cast("int").alias("hits"))


@query("queue_report", "events", sql="SELECT count(*) FILTER (event_id % 4 = 0) AS waiting, count(*) FILTER (event_id % 4 = 1) AS running, count(*) FILTER (event_id % 4 = 2) AS done, count(*) FILTER (event_id % 4 = 3) AS error, CAST(sum(CASE WHEN event_id % 4 < 2 THEN (CASE WHEN event_id % 5 = 0 THEN 1 ELSE event_id % 5 END) * (CASE WHEN event_id % 3 = 0 THEN 40 WHEN event_id % 3 = 1 THEN 25 ELSE 90 END) ELSE 0 END) AS BIGINT) AS seconds FROM events")
def _(events):
    status = F.element_at(F.array(*map(F.lit, ["aguardando", "rodando", "concluido", "erro"])), (F.col("event_id") % 4 + 1).cast("int"))
    templates = F.element_at(F.array(F.array(F.lit("todos")), F.array(F.lit("short")), F.array(F.lit("short"), F.lit("long"))), (F.col("event_id") % 3 + 1).cast("int"))
    orders = events.select(status.alias("status"), (F.col("event_id") % 5).alias("goal"), templates.alias("templates"))
    return L.queue_report(orders, {"short": 25, "long": 90}).withColumn("seconds", F.col("seconds").cast("long"))


@query("health_bands", "events", sql="SELECT event_id, CASE WHEN event_id % 13 > 10 THEN 'green' WHEN event_id % 13 > 5 THEN 'yellow' ELSE 'red' END AS disk, CASE WHEN (event_id % 4096) / 1024 > 2 THEN 'green' ELSE 'red' END AS memory, CASE WHEN event_id % 100 < 65 THEN 'green' WHEN event_id % 100 < 85 THEN 'yellow' ELSE 'red' END AS processor, event_id / 30.0 AS rate FROM events")
def _(events):
    n = F.col("event_id")
    return events.select(n, L.disk_band(n % 13).alias("disk"), L.memory_band(n % 4096).alias("memory"), L.processor_band(n % 100).alias("processor"), L.throughput(n, n * 2, F.lit(30.0))["rate"].alias("rate"))


@query("folder_formats", "pages", sql="WITH f AS (SELECT regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM (SELECT 'd' || (page_id % 7) || '/f' || page_id || ['.jsonl', '.PARQUET', '.csv', '.txt', '.json', '.bin', ''][(page_id % 7) + 1] AS p FROM pages)) SELECT folder, CASE WHEN e IN ('jsonl', 'parquet', 'csv', 'txt', 'json') THEN e WHEN e <> '' THEN 'other' ELSE 'empty' END AS format, CASE e WHEN 'jsonl' THEN 'sanitise' WHEN 'json' THEN 'sanitise' WHEN 'parquet' THEN 'light_clean' WHEN 'csv' THEN 'light_clean' WHEN 'txt' THEN 'encoding' ELSE 'none' END AS treatment, count(*) AS files FROM f GROUP BY 1, 2, 3")
def _(pages):
    k = F.col("page_id") % 7
    ends = F.element_at(F.array(*map(F.lit, [".jsonl", ".PARQUET", ".csv", ".txt", ".json", ".bin", ""])), (k + 1).cast("int"))
    return L.folder_formats(pages.select(F.concat(F.lit("d"), k, F.lit("/f"), "page_id", ends).alias("path")))


@query("hub_tags", "documents", sql="SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '1K<n<10K' END AS size, CASE WHEN doc_id % 2 = 0 THEN 'json' END AS format, lang AS languages FROM documents")
def _(docs):
    tags = F.filter(F.array(F.concat(F.lit("language:"), "lang"), F.when(ID() % 3 > 0, "size_categories:1K<n<10K"), F.lit("license:mit"), F.when(ID() % 2 == 0, "format:json")), lambda t: t.isNotNull())
    return docs.select(ID(), L.hub_tags(tags).alias("t")).select(ID(), "t.size", "t.format", F.array_join("t.languages", ",").alias("languages"))


@query("middle_files", "documents", sql="WITH f AS (SELECT source || '/' || lang AS path, count(*) AS rows FROM documents GROUP BY 1), n AS (SELECT count(*) AS n FROM f), z AS (SELECT n, CASE WHEN n >= 4 THEN greatest(1, CAST(floor(n * 0.1) AS BIGINT)) ELSE least(1, n // 2) END AS size FROM n), r AS (SELECT path, row_number() OVER (ORDER BY rows, path) - 1 AS k FROM f) SELECT path, CASE WHEN k >= (n - size) // 2 AND k < (n - size) // 2 + size THEN 'val' ELSE 'train' END AS part FROM r, z")
def _(docs):
    files = docs.groupBy(F.concat_ws("/", "source", "lang").alias("path")).agg(F.count("*").alias("rows"))
    return L.middle_files(files).select("path", "part")


@query("preferred_pages", "pages", sql=f"SELECT page_id FROM (SELECT page_id, url, {WORDS.replace('text', 'html')} AS words FROM pages) ORDER BY words DESC, url, page_id LIMIT 50")
def _(pages):
    return L.preferred(pages.select("page_id", F.concat_ws("\x01", "url", F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("url"), Q.n_words(F.col("html")).alias("words")), "complex", 50).select("page_id")


@query("mojibake_examples", "conversations", sql="SELECT conv_id, turn, md5(substr(text, 1, 300)) AS h FROM conversations WHERE regexp_matches(text, '[\\x{c0}-\\x{ff}]|Ã.|Â.') ORDER BY conv_id, turn LIMIT 3")
def _(turns):
    found = turns.filter(X().rlike(r"[\x{c0}-\x{ff}]|Ã.|Â.")).orderBy("conv_id", "turn").limit(3)
    return found.select("conv_id", "turn", F.md5(F.substring(X(), 1, 300)).alias("h"))


# corpora and resumable sinks


@query("byte_limited", "documents", sql="WITH k AS (SELECT doc_id, strlen(text) AS b FROM documents WHERE length(text) >= 100), s AS (SELECT *, coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY doc_id) AS n FROM k) SELECT doc_id FROM s WHERE before < 200000 AND n <= 150")
def _(docs):
    return corpora.limited(docs.filter(F.length(X()) >= 100), "doc_id", "text", most_bytes=200_000, most_rows=150).select(ID())


@query("joined_turns", "conversations", sql="SELECT conv_id, md5(string_agg(text, chr(32) ORDER BY turn)) AS h FROM conversations WHERE text <> '' GROUP BY conv_id")
def _(turns):
    return corpora.joined_turns(turns, "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("h"))


@job("continued_shards", "WITH r AS (SELECT doc_id, doc_id % 2 AS run FROM documents), f AS (SELECT ceil(count(*) / 50.0) AS files FROM r WHERE run = 0), p AS (SELECT doc_id, run, row_number() OVER (PARTITION BY run ORDER BY doc_id) - 1 AS k FROM r) SELECT doc_id, CAST(k // 50 + 1 + CASE WHEN run = 1 THEN files ELSE 0 END AS INT) AS shard FROM p, f")
def _(spark, sf_dir):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), sinks.scratch(spark)
    for run in (0, 1):
        sinks.append_shards(docs.filter(F.col("doc_id") % 2 == run), path, "doc_id", 50)
    return spark.read.schema("doc_id long, text string, shard int").json(path).select("doc_id", "shard")


@job("resumed_lots", f"WITH {PAIRS}, n AS (SELECT conv_id, turn, conv_id % 3 AS run FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY run > 0 ORDER BY conv_id, turn) - 1 AS k FROM n), f AS (SELECT ceil(count(*) / 50.0) AS files FROM n WHERE run = 0) SELECT conv_id, turn, CAST(k // 50 + 1 + CASE WHEN run > 0 THEN files ELSE 0 END AS INT) AS lot FROM k, f")
def _(spark, sf_dir):
    pairs, path = C.adjacent_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")), sinks.scratch(spark)
    some = pairs.withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    sinks.append_lots(some.filter("conv_id % 3 = 0"), path, "conv_id", "at", 50)
    sinks.append_lots(some, path, "conv_id", "at", 50)  # files that the first run has handled are skipped
    return spark.read.schema("conv_id long, turn long, shard int").json(f"{path}/lots").select("conv_id", "turn", F.col("shard").alias("lot"))


@job("exploded_files", "WITH b AS (SELECT source, sum(strlen(text)) AS bytes FROM documents GROUP BY 1), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) SELECT source, doc_id, CASE WHEN bytes > 100000 THEN k // 10 ELSE 0 END AS part FROM r JOIN b USING (source)")
def _(spark, sf_dir):
    return sinks.exploded(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", "doc_id", "text", 100_000, 10).select("source", "doc_id", "part")


# more of texts and turns


@query("lookahead_pairs", "conversations", sql="WITH s AS (SELECT conv_id, turn, text, CASE WHEN lower(trim(role)) = 'user' THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'bot') THEN 'assistant' END AS r FROM conversations), p AS (SELECT conv_id, turn, r, trim(text) AS q, lead(r) OVER w AS nr, trim(lead(text) OVER w) AS a FROM s WHERE r IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, md5(q) AS q, md5(a) AS a FROM p WHERE r = 'user' AND nr = 'assistant' AND q <> '' AND len(regexp_extract_all(a, '\\S+')) >= 5")
def _(turns):
    return C.lookahead_pairs(turns).select("conv_id", "turn", F.md5("question").alias("q"), F.md5("answer").alias("a"))


@query("sentence_means", "documents", sql=f"SELECT doc_id, round({WORDS} / greatest(1, len(regexp_extract_all(text, '[.!?…](\\s|$)'))), 1) AS mean FROM documents")
def _(docs):
    return docs.select(ID(), Q.words_a_sentence(X()).alias("mean"))


LISTED = ["the", "and", "que", "und", "les", "der", "ing", "tion", "ment", "xyz", "zzz", "sch"]


@query("blacklisted", "documents", sql="SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in LISTED) + " >= 6 AS listed FROM documents")
def _(docs):
    return docs.select(ID(), Q.blacklisted(X(), LISTED, 6).alias("listed"))


@query("request_prices", "conversations", sql=f"WITH t AS (SELECT conv_id, turn, {WORDS} AS n FROM conversations) SELECT conv_id, turn, round(n / 1e6 * 0.14 + floor(n * 0.3) / 1e6 * 0.28, 8) AS price FROM t")
def _(turns):
    return turns.select("conv_id", "turn", Q.request_cost(Q.n_words(X()), 0.14, 0.28).alias("price"))


@query("pair_digests", "conversations", sql=f"WITH {PAIRS} SELECT conv_id, turn, md5(lower(trim(q))) AS prompt, md5(q || chr(1) || a) AS both, substr(md5(q || '|' || a), 1, 16) AS short FROM t")
def _(turns):
    return C.adjacent_pairs(turns).select("conv_id", "turn", Q.digests(F.col("question"), F.col("answer")).alias("d")).select("conv_id", "turn", "d.*")


@query("page_context", "documents", sql="WITH d AS (SELECT doc_id // 4 AS g, doc_id, text, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS k FROM documents), c AS (SELECT g, string_agg(substr(text, 1, 2000), ' ' ORDER BY doc_id) FILTER (k <= 3 AND length(text) > 200) AS t FROM d GROUP BY g) SELECT g, md5(array_to_string(regexp_extract_all(coalesce(t, ''), '\\S+')[1:500], ' ')) AS h FROM c")
def _(docs):
    some = docs.groupBy(F.floor(ID() / 4).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct(ID(), X()))), lambda x: x["text"]).alias("p"))
    return some.select("g", F.md5(T.context_of(F.col("p"))).alias("h"))


@query("elite_folders", "documents", sql="WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-záéíóúâêôãõàüçñ]+') AS w FROM documents), s AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) < 30 THEN 0.0 ELSE CAST(len(list_distinct(w)) AS DOUBLE) / len(w) END AS ttr FROM t), r AS (SELECT doc_id, row_number() OVER (ORDER BY ttr DESC, n DESC, doc_id) - 1 AS place FROM s) SELECT doc_id, place, place // 30 AS folder FROM r WHERE place < (SELECT greatest(1, CAST(round_even(count(*) * 0.4, 0) AS BIGINT)) FROM documents)")
def _(docs):
    rows = docs.select(ID(), Q.ttr(X()).alias("ttr"), F.size(Q.tokens(X())).alias("n"))
    kept = best(rows, "ttr", [F.desc("n"), "doc_id"], max(1, round(0.4 * docs.count())))
    return kept.select(ID(), "place", F.floor(F.col("place") / 30).alias("folder"))


# streams, run over what is there


def event_stream(spark, sf_dir, files: int = 3):
    """The events as a stream of several files, a batch each; ts as a timestamp."""
    path = sinks.scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.repartitionByRange(files, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@job("stream_first_seen", "SELECT DISTINCT event_type || '/' || (user_id % 50) AS key FROM events")
def _(spark, sf_dir):
    keyed = event_stream(spark, sf_dir).withColumn("key", F.concat_ws("/", "event_type", F.col("user_id") % 50))
    target = sinks.scratch(spark)
    pickup.drain(pickup.first_seen(keyed, "key", "ts", "3650 days").select("key"), target, sinks.scratch(spark))
    return spark.read.schema("key string").parquet(target)


@job("stream_counts", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    target = sinks.scratch(spark)
    counts = pickup.counts_by_window(event_stream(spark, sf_dir), "ts", "event_type", "1 day", "3650 days").select(F.unix_timestamp("start").alias("start"), "event_type", "n")
    pickup.drain(counts, target, sinks.scratch(spark), "complete")
    return spark.read.schema("start long, event_type string, n long").parquet(target)


# the flagship with all stages


@query("light_clean_full", "documents", heavy=True)
def _(docs):
    return light_clean_full(docs, ["en", "fr"], cut=sinks.written).groupBy("status").agg(F.count("*").alias("n"))
