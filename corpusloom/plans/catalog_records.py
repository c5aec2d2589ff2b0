"""Queries over rules, examples, readers, sinks, joins and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import rules as R
from ..functions import text as T
from ..operators import conversation as C
from ..operators import crawl
from ..operators import dedup as D
from ..operators import examples as E
from ..sources import readers, sinks
from ..streaming import pickup
from .catalog import _QUERIES, _SQL, LINES, REASON, TOKENS, WORDS, query
from .light_clean import sanitize


def job(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir): one that writes and reads files."""

    def add(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def ID():  # noqa: N802
    return F.col("doc_id")


def X():  # noqa: N802
    return F.col("text")


PAIRS = "p AS (SELECT conv_id, turn, text AS q, lead(role) OVER w AS nr, lead(text) OVER w AS a, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), t AS (SELECT conv_id, turn, q, a, 'Pergunta: ' || q || chr(10) || 'Resposta: ' || a AS text FROM p WHERE role = 'user' AND nr = 'assistant' AND trim(q) <> '' AND trim(a) <> '')"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CONTACTS = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)https?://\\S+|www\\.\\S+', '', 'g'), '\\S+@\\S+\\.\\S+', '', 'g'), '\\(\\d{{2}}\\)\\s?\\d{{4,5}}-\\d{{4}}', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g'))"
BEST = "coalesce(list_max(map_values(list_aggregate({}, 'histogram'))), 0)"


def pair_texts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer, text in the marked question and answer form."""
    return C.adjacent_pairs(turns).withColumn("text", F.concat(F.lit("Pergunta: "), "question", F.lit("\nResposta: "), "answer"))


# rules


@query("dialogue_quality", "conversations", sql=f"WITH {PAIRS}, s AS (SELECT conv_id, turn, regexp_extract_all(q, '\\S+') AS x, regexp_extract_all(a, '\\S+') AS y, regexp_extract_all(q || ' ' || a, '\\S+') AS z FROM t) SELECT conv_id, turn, len(x) >= 4 AND len(y) >= 10 AND len(list_distinct(z)) >= 0.06 * len(z) AS ok FROM s")
def _(turns):
    return C.adjacent_pairs(turns).select("conv_id", "turn", R.dialogue_ok(F.col("question"), F.col("answer")).alias("ok"))


@query("answer_format", "conversations", sql=f"WITH {PAIRS}, m AS (SELECT *, trim(regexp_extract(text, '(?s)Resposta:(.*)', 1)) AS ans FROM t) SELECT conv_id, turn, length(ans) >= 8 AND NOT ends_with(ans, '...') AND NOT contains(ans, '��') AS ok, CASE WHEN length(trim(text)) < 20 THEN 'short' WHEN length(ans) < 5 THEN 'short_answer' END AS reason FROM m")
def _(turns):
    return pair_texts(turns).select("conv_id", "turn", R.answer_format(X()).alias("ok"), R.invalid_reason(X()).alias("reason"))


@query("question_answer", "conversations", sql=f"WITH {PAIRS} SELECT conv_id, turn, md5({CONTACTS.format('q')}) AS q, md5({CONTACTS.format('a')}) AS a FROM t")
def _(turns):
    found = pair_texts(turns).select("conv_id", "turn", R.question_answer(X()).alias("x"))
    return found.select("conv_id", "turn", F.md5("x.question").alias("q"), F.md5("x.answer").alias("a"))


@query("question_split", "documents", sql=f"WITH s AS (SELECT doc_id, instr(text, '?') AS k, text FROM documents WHERE NOT regexp_matches(text, '(?i)(Perg|Resp|Usu[áa]rio|Pessoa|Outra)')) SELECT doc_id, md5({CONTACTS.format('substr(text, 1, k)')}) AS q FROM s WHERE k > 6 AND length(text) - k > 5 AND {CONTACTS.format('substr(text, 1, k)')} <> '' AND {CONTACTS.format('substr(text, k + 1)')} <> ''")
def _(docs):
    plain = docs.filter(~X().rlike("(?i)(Perg|Resp|Usu[áa]rio|Pessoa|Outra)"))
    return plain.select(ID(), R.question_answer(X())["question"].alias("q")).filter("q is not null").select(ID(), F.md5("q").alias("q"))


@query("qa_blocks", "conversations", sql=f"WITH {PAIRS}, j AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM t GROUP BY conv_id) SELECT conv_id, len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: contains(x, 'Pergunta:') AND contains(x, 'Resposta:'))) AS n FROM j")
def _(turns):
    joined = pair_texts(turns).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return joined.select("conv_id", F.size(R.blocks(X())).cast("long").alias("n"))


DIALOGUE = "d AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Pessoa: ' ELSE 'Outra: ' END || text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id), f AS (SELECT conv_id, text, list_filter(list_transform(string_split_regex(text, '(Pessoa|Outra)\\s*:')[2:], lambda x: len(regexp_extract_all(x, '\\S+'))), lambda n: n > 0) AS w FROM d)"


@query("dialogue_reason", "conversations", sql=f"WITH {DIALOGUE} SELECT conv_id, CASE WHEN NOT contains(text, 'Pessoa:') OR NOT contains(text, 'Outra:') THEN 'marks' WHEN len(regexp_extract_all(text, '(?i)(Pessoa|Outra)\\s*:')) < 4 THEN 'few_turns' WHEN len(w) = 0 OR list_min(w) < 5 THEN 'short_turn' WHEN {WORDS} < 80 THEN 'short' ELSE 'ok' END AS reason FROM f")
def _(turns):
    said = turns.filter("role in ('user', 'assistant')").select("conv_id", "turn", F.concat(F.when(F.col("role") == "user", "Pessoa: ").otherwise("Outra: "), X()).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n")
    return said.groupBy("conv_id").agg(text.alias("text")).select("conv_id", R.dialogue_reason(X(), 4).alias("reason"))


SENTENCES = "list_transform(list_filter(string_split_regex(text, '[.!?]+'), lambda s: len(regexp_extract_all(s, '\\S+')) > 5), lambda s: trim(regexp_replace(regexp_replace(lower(trim(s)), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', ' ', 'g')))"


@query("self_repetition", "documents", sql=f"WITH s AS (SELECT doc_id, {SENTENCES} AS k FROM documents) SELECT doc_id, len(k) >= 2 AND {BEST.format('k')} > 0.3 * len(k) AS repeats FROM s")
def _(docs):
    return docs.select(ID(), R.repeats_itself(X()).alias("repeats"))


@query("bulk_reason", "documents", sql=f"WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w, list_filter(list_transform(string_split(replace(replace(text, '! ', '. '), '? ', '. '), '. '), lambda s: {STRIP.format('s')}), lambda s: s <> '') AS f FROM documents) SELECT doc_id, CASE WHEN length(text) < 30 THEN 'short' WHEN {BEST.format('w')} > 0.4 * len(w) THEN 'repeated_word' WHEN {BEST.format('f')} >= 3 THEN 'repeated_sentence' END AS reason FROM s")
def _(docs):
    return docs.select(ID(), R.bulk_reason(X()).alias("reason"))


VERDICTS = ["Aprovado", "Não aprovado", "Suspeito, mas aprovado", "Aprovaço", "reprovado"]


@query("verdicts", "events", sql="WITH v AS (SELECT event_id, [" + ", ".join(f"'{v}'" for v in VERDICTS) + f"][event_id % {len(VERDICTS)} + 1] AS v FROM events) SELECT event_id, NOT regexp_matches(lower(v), 'suspeit|não aprov|nao aprov') AND regexp_matches(lower(v), 'aprovad|aprovaç') AS ok FROM v")
def _(events):
    said = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), (F.col("event_id") % len(VERDICTS) + 1).cast("int"))
    return events.select("event_id", R.approved(said).alias("ok"))


def _hits(words):
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)


@query("portuguese_variety", "documents", sql=f"WITH s AS (SELECT doc_id, {_hits(R.BRAZIL)} AS br, {_hits(R.PORTUGAL)} + " + " + ".join(f"2 * CAST(regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])tu {v}($|[^\\p{{L}}\\p{{N}}_])') AS INT)" for v in R.TU_VERBS) + " AS pt FROM documents) SELECT doc_id, br - pt AS score, CASE WHEN br >= 3 AND br > pt THEN 'br' WHEN pt >= 3 AND br < pt THEN 'pt' WHEN pt > 0 AND br = 0 THEN 'pt' WHEN br > 0 AND pt = 0 THEN 'br' ELSE '?' END AS guess FROM s")
def _(docs):
    return docs.select(ID(), R.variety(X()).alias("v")).select(ID(), "v.score", "v.guess")


@query("latin_script", "documents", sql="SELECT doc_id, length(text) < 60 OR NOT regexp_matches(text, '[\\p{Cyrillic}\\p{Greek}\\p{Arabic}\\p{Hebrew}\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}\\p{Thai}]') AS latin FROM documents")
def _(docs):
    return docs.select(ID(), ((F.length(X()) < 60) | ~X().rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArabic}\p{IsHebrew}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]")).alias("latin"))


@query("length_gates", "documents", sql=f"SELECT doc_id, length(text) >= 30 AS dialogue, length(text) >= 50 AND {WORDS} >= 5 AS running, length(trim(text)) >= 20 AS line FROM documents")
def _(docs):
    n = F.length(X())
    return docs.select(ID(), (n >= 30).alias("dialogue"), ((n >= 50) & (Q.n_words(X()) >= 5)).alias("running"), (F.length(F.trim(X())) >= 20).alias("line"))


@query("length_class", "documents", sql=f"SELECT doc_id, CASE WHEN {WORDS} < 500 THEN 'short' WHEN {WORDS} < 1200 THEN 'long' ELSE 'complete' END AS class FROM documents")
def _(docs):
    return docs.select(ID(), R.length_class(X()).alias("class"))


@query("fact_claims", "documents", sql="WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) BETWEEN 40 AND 400 AND regexp_matches(x, '\\d|(?i)\\b(the|de|der)\\b')) AS s FROM documents), h AS (SELECT doc_id, s, list_transform(s, lambda x: lower(substr(x, 1, 80))) AS h FROM s), f AS (SELECT doc_id, list_filter(s, lambda x, i: list_position(h, h[i]) = i)[1:3] AS f FROM h) SELECT doc_id, CAST(unnest(generate_series(0, len(f) - 1)) AS INT) AS rank, unnest(f) AS claim FROM f WHERE len(f) > 0")
def _(docs):
    return docs.select(ID(), F.posexplode(R.fact_sentences(X(), r"\d|(?i)\b(the|de|der)\b")).alias("rank", "claim"))


@query("encoding_check", "documents", sql="SELECT doc_id, true AS utf8, length(text) - length(replace(text, '�', '')) AS replaced, len(regexp_extract_all(text, 'Ã[\\x{80}-\\x{BF}]|â€')) AS mojibake FROM documents")
def _(docs):
    return docs.select(ID(), F.is_valid_utf8(X()).alias("utf8"), (F.length(X()) - F.length(F.replace(X(), F.lit("�"), F.lit("")))).cast("long").alias("replaced"), F.regexp_count(X(), F.lit(r"Ã[\x{80}-\x{BF}]|â€")).cast("long").alias("mojibake"))


# text functions


def _replaced(c):
    for wrong, right in T.MOJIBAKE.items():
        c = f"replace({c}, '{wrong}', '{right.replace(chr(39), chr(39) * 2)}')"
    return c


@query("mojibake_table", "documents", sql=f"SELECT doc_id, md5(trim(regexp_replace({_replaced('text')}, '\\s+', ' ', 'g'))) AS h FROM documents")
def _(docs):
    return docs.select(ID(), F.md5(T.fix_mojibake_table(X())).alias("h"))


@query("drop_emoji", "documents", sql="SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '▁', ' '), '[\\x{1F300}-\\x{1FAFF}\\x{2500}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE0F}\\x{200D}]', '', 'g'), ' {2,}', ' ', 'g'), '\\n +', chr(10), 'g'))) AS h FROM documents")
def _(docs):
    return docs.select(ID(), F.md5(T.drop_emoji(X())).alias("h"))


@query("unified_markers", "documents", sql="SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(text, '**', ''), '__', ''), '(?i)\\bpessoa\\s*:', 'Pessoa:', 'g'), '(?i)\\boutra\\s*:', 'Outra:', 'g')) AS h FROM documents")
def _(docs):
    return docs.select(ID(), F.md5(T.unify_markers(X())).alias("h"))


@query("answer_part", "conversations", sql=f"WITH {PAIRS} SELECT conv_id, turn, md5(trim(list_extract(string_split(text, 'Resposta:'), -1))) AS h FROM t")
def _(turns):
    return pair_texts(turns).select("conv_id", "turn", F.md5(T.answer_part(X())).alias("h"))


def _body(listed):
    return f"list_transform(r, lambda x: NOT regexp_matches(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '^$|^({'|'.join(listed)})'))"


@query("trimmed_article", "documents", sql=f"WITH r AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS r FROM documents), p AS (SELECT doc_id, r, coalesce(list_position({_body(R.OPENINGS)}, true), 0) AS a, len(r) + 1 - coalesce(nullif(list_position(list_reverse({_body(R.CLOSINGS)}), true), 0), len(r) + 1) AS b FROM r), t AS (SELECT doc_id, CASE WHEN a > 0 AND b >= a THEN regexp_replace(array_to_string(r[a:b], chr(10)), '^\\s+|\\s+$', '', 'g') ELSE '' END AS t FROM p) SELECT doc_id, length(t) AS chars, md5(t) AS h, nullif(regexp_extract(t, '(?m)^#\\s+(.+)$', 1), '') AS topic FROM t")
def _(docs):
    body = R.trimmed_article(X())
    return docs.select(ID(), F.length(body).alias("chars"), F.md5(body).alias("h"), R.article_topic(body).alias("topic"))


STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
HEADS = "(?i)[a-zà-úç](?:[ ]+[a-zà-úç]){2,}[^|]*\\|[a-zà-úç](?:[ ]+[a-zà-úç])+"
BOOK = f"""WITH r AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda s: {STRIPPED.format("s")}), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)sol\\.indd|bb\\s+preto|^\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}$|^www\\.|^http')
 AND NOT regexp_matches(s, '(?i)^\\d{{1,4}}\\s*$|^[ivxlcdm]{{1,4}}\\s*$') AND NOT (regexp_matches(s, '\\|[a-zçáéíóúâêôãõ]') AND length(s) - length(replace(s, ' ', '')) > length(s) / 3)) AS r FROM documents),
 c AS (SELECT doc_id, list_transform(r, lambda s: {STRIPPED.format("regexp_replace(" + STRIPPED.format("regexp_replace(s, '" + HEADS + "', ' ', 'g')") + ", '\\b\\d{1,2}/\\d{1,2}/\\d{2,4}\\s+\\d{1,2}:\\d{2}\\b', '', 'g')")}) AS r FROM r)
SELECT doc_id, md5(array_to_string(list_filter(r, lambda s: s <> ''), ' ')) AS h FROM c"""


@query("book_text", "documents", sql=BOOK)
def _(docs):
    return docs.select(ID(), F.md5(R.book_text(X())).alias("h"))


@query("chapters", "documents")
def _(docs):
    return docs.select(ID(), F.posexplode(R.chapters(X())).alias("chapter", "body")).select(ID(), "chapter", F.length("body").alias("chars"))


@query("theme", "documents", sql="SELECT doc_id, coalesce(list_filter(list_transform(string_split_regex(text, '[.!?]\\s+'), lambda s: trim(s)), lambda s: length(s) BETWEEN 20 AND 90)[1], trim(substr(text, 1, 80))) AS theme FROM documents")
def _(docs):
    return docs.select(ID(), R.theme(X()).alias("theme"))


@query("context_cut", "documents", sql="SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '\\S+')[1:500], ' ')) AS h FROM documents")
def _(docs):
    return docs.select(ID(), F.md5(R.shortened(X())).alias("h"))


@query("title_question", "pages", sql="WITH t AS (SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '\\s+[—|–-]\\s+[^—|–-]*$', '')) AS b FROM pages) SELECT page_id, upper(substr(b, 1, 1)) || substr(b, 2) || CASE WHEN ends_with(b, '?') THEN '' ELSE '?' END AS question FROM t")
def _(pages):
    return pages.select("page_id", R.question_from_title(T.page_title(F.col("html"))).alias("question"))


@query("news_name", "documents", sql="SELECT doc_id, 'news' || substr(sha256(text), 1, 4) || chr(CAST(97 + doc_id % 26 AS INT)) AS name FROM documents")
def _(docs):
    return docs.select(ID(), F.concat(F.lit("news"), F.substring(F.sha2(X(), 256), 1, 4), F.char(97 + ID() % 26)).alias("name"))


@query("nfkc_text", "documents")
def _(docs):
    return docs.select(ID(), F.md5(F.trim(F.regexp_replace(F.regexp_replace(T.nfkc(X()), T.CONTROL, ""), r"[ \t]+", " "))).alias("h"))


# records and examples


RECORDS = "r AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"


def records(turns: DataFrame) -> DataFrame:
    """conv_id, record: a conversation as one JSON line."""
    return C.messages(turns).select("conv_id", F.to_json(F.struct("messages")).alias("record"))


@query("record_messages", "conversations", sql=f"WITH {RECORDS} SELECT conv_id, len(m) AS n, md5(array_to_string(list_transform(m, lambda x: x.role || ':' || trim(x.content)), chr(10))) AS h FROM r WHERE len(m) >= 2")
def _(turns):
    found = records(turns).select("conv_id", E.record_messages(F.col("record")).alias("m")).filter("m is not null")
    return found.select("conv_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "\n")).alias("h"))


@query("record_system", "conversations", sql=f"WITH {RECORDS} SELECT conv_id, len(m) + CASE WHEN m[1].role = 'system' THEN 0 ELSE 1 END AS n FROM r WHERE len(m) >= 2")
def _(turns):
    found = records(turns).select("conv_id", E.with_system(E.record_messages(F.col("record"))).alias("m")).filter("m is not null")
    return found.select("conv_id", F.size("m").cast("long").alias("n"))


@query("record_text", "conversations", sql=f"WITH {RECORDS} SELECT conv_id, CASE WHEN len(m) >= 2 THEN md5(array_to_string(list_transform(m, lambda x: trim(x.content)), chr(10))) ELSE md5('') END AS h FROM r")
def _(turns):
    return records(turns).select("conv_id", F.md5(E.record_text(F.col("record"))).alias("h"))


@query("causal_text", "documents", sql="SELECT doc_id, md5(trim(text)) AS h FROM documents WHERE trim(text) <> ''")
def _(docs):
    found = docs.select(ID(), E.causal_text(F.to_json(F.struct("text"))).alias("t"))
    return found.filter("t is not null").select(ID(), F.md5("t").alias("h"))


@query("standard_example", "conversations", sql=f"WITH {RECORDS}, s AS (SELECT conv_id, list_filter(m, lambda x: x.role = 'user')[1].content AS u, list_filter(m, lambda x: x.role = 'assistant')[1].content AS a FROM r) SELECT conv_id, substr(md5(u || '|' || a), 1, 16) AS id, CASE WHEN contains(u, '?') THEN 'qna' ELSE 'artigo' END AS kind, trim(u) AS subject FROM s WHERE u <> '' AND a <> ''")
def _(turns):
    found = C.messages(turns).select("conv_id", E.standard_example(F.col("messages"), F.lit(None).cast("string")).alias("x")).filter("x is not null")
    return found.select("conv_id", "x.id", "x.kind", "x.subject")


@query("record_format", "conversations", sql=f"WITH {RECORDS} SELECT 'messages' AS format, count(*) AS n FROM r UNION ALL SELECT 'instruction', count(*) FROM conversations UNION ALL SELECT 'text', count(*) FROM conversations")
def _(turns):
    rows = records(turns).select("record").union(turns.select(F.to_json(F.struct(X().alias("instruction"), X().alias("output"))))).union(turns.select(F.to_json(F.struct(X().alias("text")))))
    return rows.groupBy(R.format_of(F.col("record")).alias("format")).agg(F.count("*").alias("n"))


@query("format_dominant", "events", sql="WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, arg_max(event_type, (n, event_type)) AS dominant, max(n) / sum(n) AS share FROM c GROUP BY 1) SELECT user_id, dominant, CASE WHEN share >= 0.95 THEN 'pure' WHEN share > 0.5 THEN 'mixed' ELSE 'varied' END AS diagnosis FROM s")
def _(events):
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    found = counts.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("dominant"), (F.max("n") / F.sum("n")).alias("share"))
    return found.select("user_id", "dominant", F.when(F.col("share") >= 0.95, "pure").when(F.col("share") > 0.5, "mixed").otherwise("varied").alias("diagnosis"))


# files: written to and read from the shared folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@job("json_shards", "SELECT doc_id, source, md5(text) AS h FROM documents")
def _(spark, sf_dir):
    path = sinks.scratch(spark)
    sinks.write_shards(documents(spark, sf_dir), path, "source", "doc_id", 20)
    found = readers.read_records(spark, path, longest=(1 << 31) - 1).select(F.from_json("record", "doc_id long, source string, text string").alias("x"))
    return found.select("x.doc_id", "x.source", F.md5("x.text").alias("h"))


@job("json_shard_sizes", "WITH s AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS shard FROM documents) SELECT source, shard, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, sf_dir):
    return sinks.sharded(documents(spark, sf_dir), "source", "doc_id", 20).groupBy("source", "shard").agg(F.count("*").alias("n"))


@job("json_lines", "SELECT count(*) AS n, count(*) FILTER (trim(text) = '') AS blank, count(*) FILTER (length(text) > 500) AS long FROM documents")
def _(spark, sf_dir):
    path = sinks.scratch(spark)
    documents(spark, sf_dir).select(F.to_json(F.struct(F.length(X()).alias("n"), (F.trim(X()) == "").alias("b"))).alias("value")).write.text(path)
    lines = readers.read_lines(spark, path)
    got = F.from_json("record", "n long, b boolean")
    return lines.filter("reason is null").agg(F.count("*").alias("n"), F.count_if(got["b"]).alias("blank"), F.count_if(got["n"] > 500).alias("long"))


@job("twin_output", "WITH r AS (SELECT conv_id, count(*) >= 2 AND bool_and(role IN ('system', 'user', 'assistant') AND trim(text) <> '') AS ok FROM conversations GROUP BY 1) SELECT count(*) AS read, count(*) FILTER (ok) AS sft, count(*) AS pretrain FROM r")
def _(spark, sf_dir):
    path = sinks.scratch(spark)
    sinks.write_twin(C.messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), path)
    return spark.read.schema("read long, sft long, pretrain long").json(f"{path}/report")


@job("csv_posts", "SELECT md5(regexp_replace(text, '[\\r\\n]', ' ', 'g')) AS h FROM documents WHERE length(text) >= 200")
def _(spark, sf_dir):
    path = sinks.scratch(spark)
    documents(spark, sf_dir).select(ID(), "lang", "source", "n_chars", F.regexp_replace(X(), r"[\r\n]", " ").alias("text")).write.option("sep", ";").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_posts(spark, path).select(F.md5("text").alias("h"))


@job("feed_items", "SELECT page_id, url FROM pages")
def _(spark, sf_dir):
    path = sinks.scratch(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.select(F.col("page_id").alias("title"), F.col("url").alias("link")).write.format("xml").option("rowTag", "item").save(path)
    return readers.read_feed(spark, path).select(F.col("title").cast("long").alias("page_id"), F.col("link").alias("url"))


@job("picked_up", f"SELECT doc_id, {REASON} AS reason FROM documents")
def _(spark, sf_dir):
    base = sinks.scratch(spark)
    rows = documents(spark, sf_dir)
    source = f"{sf_dir}/documents.parque[t]"  # a pattern, as a stream's plain path must be a folder: the table is a file or a folder of files
    for _ in range(2):  # the second run finds nothing new
        pickup.pick_up(spark, source, f"{base}/out", f"{base}/state", rows.schema, lambda d: d.select("doc_id", Q.quality_reason(X()).alias("reason")), "*")
    return spark.read.schema("doc_id long, reason string").parquet(f"{base}/out")


# joins, sets, promotion


@query("promoted", "documents", sql=f"SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING bool_and({WORDS} >= 2))")
def _(docs):
    return sinks.whole_groups(docs, "source", Q.n_words(X()) >= 2).select(ID())


@query("review_rule", "documents", sql="SELECT source, bool_and(length(text) > 10) AS passed, count(*) AS lines FROM documents GROUP BY source")
def _(docs):
    return docs.groupBy("source").agg(F.every(F.length(X()) > 10).alias("passed"), F.count("*").alias("lines"))


@query("export_manifest", "documents", sql="WITH s AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS total FROM documents) SELECT doc_id FROM s WHERE total <= 100000")
def _(docs):
    return sinks.manifest(docs, "n_chars", "doc_id", 100_000).select(ID())


@query("first_user_fold_dedup", "conversations", sql="WITH f AS (SELECT conv_id, lower(arg_min(text, turn)) AS k FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, conv_id > min(conv_id) OVER (PARTITION BY k) AS is_dup FROM f")
def _(turns):
    first = turns.filter("role = 'user'").groupBy("conv_id").agg(F.lower(F.min_by("text", "turn")).alias("k"))
    return D.duplicates(first, F.col("k"), "conv_id")


@query("content_twins", "documents", sql="SELECT sha1(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(docs):
    return docs.groupBy(F.sha1(X()).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("line_dedup", "documents", sql=f"WITH l AS (SELECT DISTINCT doc_id, lower(unnest({LINES})) AS line FROM documents) SELECT md5(line) AS h, min(doc_id) AS first FROM l GROUP BY line")
def _(docs):
    rows = docs.select(ID(), F.explode(F.transform(Q.lines(X()), F.lower)).alias("line"))
    return rows.groupBy(F.md5("line").alias("h")).agg(F.min("doc_id").alias("first"))


@query("chunk_dedup", "documents", sql=f"WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), c AS (SELECT doc_id, i, array_to_string(w[i:i + 31], ' ') AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1, 32)) AS i FROM w)) SELECT count(*) AS chunks, count(DISTINCT c) AS kinds FROM c")
def _(docs):
    w = Q.tokens(X())
    rows = docs.select(w.alias("w")).filter("size(w) > 0").select(F.explode(F.transform(F.expr("sequence(1, size(w), 32)"), lambda i: F.md5(F.array_join(F.slice("w", i, 32), " ")))).alias("c"))
    counted = rows.groupBy("c").agg(F.count("*").alias("n"))
    return counted.agg(F.sum("n").alias("chunks"), F.count("*").alias("kinds"))


@query("registry_lookup", "documents", "labels", sql="SELECT doc_id, coalesce(quality, 4) AS mark FROM documents LEFT JOIN labels USING (doc_id)")
def _(docs, labels):
    return docs.select(ID()).join(labels.select("doc_id", "quality"), "doc_id", "left").select(ID(), F.coalesce("quality", F.lit(4)).alias("mark"))


@query("has_counterpart", "documents", "labels", sql="SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(docs, labels):
    return docs.select(ID()).join(labels.select("doc_id"), "doc_id", "left_semi")


@query("times_used", "events", sql="WITH n AS (SELECT user_id, count(*) AS times FROM events WHERE event_type = 'click' GROUP BY 1) SELECT event_id FROM events LEFT JOIN n USING (user_id) WHERE coalesce(times, 0) < 25")
def _(events):
    used = events.filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("times"))
    return events.join(used, "user_id", "left").filter(F.coalesce("times", F.lit(0)) < 25).select("event_id")


@query("link_reach", "pages", sql="WITH RECURSIVE e AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^(www|m)\\.', '') AS host, unnest(regexp_extract_all(html, 'href=\"(/[^\"/]+)\"', 1)) AS path FROM pages), x AS (SELECT host AS source, path AS target FROM e UNION SELECT path, host FROM e), b AS (SELECT (SELECT min(host) FROM e) AS node, 0 AS depth UNION SELECT x.target, b.depth + 1 FROM b JOIN x ON x.source = b.node WHERE b.depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY node")
def _(pages):
    host = F.regexp_replace(F.regexp_extract("url", "^https?://([^/?#]+)", 1), r"^(www|m)\.", "")
    e = pages.select(host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"/]+)"'), F.lit(1))).alias("path")).distinct()
    edges = e.select(F.col("host").alias("source"), F.col("path").alias("target")).union(e.select("path", "host"))
    return crawl.reach(edges, e.agg(F.min("host").alias("node")), 3)


# reports, windows, samples


@query("sanitize_report", "documents")
def _(docs):
    rows = sanitize(docs)
    return rows.agg(F.count("*").alias("read"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "corrected", "discarded")], F.round(F.avg((F.col("verdict") == "discarded").cast("double")), 3).alias("rate"))


@query("folder_readiness", "conversations", sql="WITH v AS (SELECT conv_id % 10 AS folder, conv_id, count(*) >= 2 AND bool_and(role IN ('system', 'user', 'assistant') AND trim(text) <> '') AS ok FROM conversations GROUP BY conv_id) SELECT folder, 100.0 * count(*) FILTER (ok) / count(*) AS share, CASE WHEN 100 * count(*) FILTER (ok) >= 95 * count(*) THEN 'ready' WHEN count(*) FILTER (ok) > 0 THEN 'mixed' ELSE 'unfit' END AS verdict FROM v GROUP BY folder")
def _(turns):
    rows = C.messages(turns).select((F.col("conv_id") % 10).alias("folder"), C.valid(F.col("messages")).alias("ok"))
    n, good = F.count("*"), F.count_if("ok")
    return rows.groupBy("folder").agg((100.0 * good / n).alias("share"), F.when(100 * good >= 95 * n, "ready").when(good > 0, "mixed").otherwise("unfit").alias("verdict"))


@query("approval_rate", "labels", sql="SELECT avg(quality) AS rate, count(*) AS n FROM labels")
def _(labels):
    return labels.agg(F.avg("quality").alias("rate"), F.count("*").alias("n"))


@query("missing_stages", "events", sql="WITH s AS (SELECT user_id, list_distinct(list(event_type)) AS have FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'refund'], lambda x: NOT list_contains(have, x))), ',') AS missing FROM s")
def _(events):
    have = events.groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return have.select("user_id", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, ("click", "error", "purchase", "refund"))), "have")), ",").alias("missing"))


@query("topic_status", "documents", "labels", sql="SELECT source, count(*) AS total, count(l.doc_id) AS used, count(*) - count(l.doc_id) AS remaining, min(CASE WHEN l.doc_id IS NULL THEN d.doc_id END) AS next FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def _(docs, labels):
    rows = docs.select("source", "doc_id").join(labels.select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count("l").alias("used"), (F.count("*") - F.count("l")).alias("remaining"), F.min(F.when(F.col("l").isNull(), ID())).alias("next"))


@query("invalid_char_top", "documents", sql="WITH c AS (SELECT unnest(regexp_extract_all(text, '[^" + T.ABNT2.replace("'", "''") + "]')) AS ch FROM documents) SELECT ch, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, ch LIMIT 30")
def _(docs):
    counted = docs.select(F.explode(F.regexp_extract_all(X(), F.lit(f"[^{T.ABNT2}]"), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "ch").limit(30)


@query("per_source_sample", "documents", sql="SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS k FROM documents) WHERE k <= 5")
def _(docs):
    # array_agg of a bounded number of smallest keys needs no sort of a source in one task
    key = F.md5(ID().cast("string"))
    ranked = docs.select("source", ID(), key.alias("k"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("k")) <= 5
    salted = ranked.withColumn("in", first("source", "salt")).filter("in")
    return salted.withColumn("in", first("source")).filter("in").select("source", ID())


@query("priority_order", "documents", sql="SELECT lang, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, sum(n_chars) DESC, lang) AS place FROM documents GROUP BY lang")
def _(docs):
    sums = docs.groupBy("lang").agg(F.sum("n_chars").alias("n"))
    return sums.select("lang", F.row_number().over(Window.orderBy(F.expr("case lang when 'en' then 0 when 'fr' then 1 else 2 end"), F.desc("n"), "lang")).cast("long").alias("place"))


@query("balanced_weights", "documents", "labels", sql="WITH u AS (SELECT source, count(*) AS times FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT doc_id, 1.0 / (1 + coalesce(times, 0)) AS weight FROM documents LEFT JOIN u USING (source)")
def _(docs, labels):
    used = docs.select("doc_id", "source").join(labels.select("doc_id"), "doc_id").groupBy("source").agg(F.count("*").alias("times"))
    return crawl.balanced_order(docs.select("doc_id", "source"), "source", used, "doc_id").select(ID(), "weight")


@query("request_cost", "conversations", sql=f"SELECT conv_id, CAST(sum({WORDS}) AS BIGINT) AS words, sum({WORDS}) * 13 * 130 AS units FROM conversations GROUP BY 1")
def _(turns):
    words = F.sum(Q.n_words(X()))
    return turns.groupBy("conv_id").agg(words.alias("words"), (words * 13 * 130).alias("units"))


@query("events_by_hour", "events", sql="SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(events):
    return pickup.counts_by_window(events, "ts", "event_type").select(F.unix_timestamp("start").alias("start"), "event_type", "n")
