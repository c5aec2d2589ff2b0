"""Rules, pages, pairs, lookups, sinks and archives: literal cases, odd rows, and plain code for what SQL can't say."""

import gzip
import io
import random
import re
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F


def column(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, t {kind}")
    return [r[1] for r in sorted(rows.select("k", fn(F.col("t"))).collect())]


def test_answer_reasons(spark):
    from corpusloom.functions import generated as G

    long = " ".join(f"palavra{k}" for k in range(60)) + "."
    cases = {
        None: "empty", "": "empty", "   ": "empty", "abc": "truncated", "uma frase que para...": "truncated", "Talvez": "vague", "Não sei": "vague", "Espero ter ajudado sempre": "weak", "texto com �� dentro dele": "strange",
        "veja <b>isto</b> aqui": "markup", "use `codigo` aqui": "markup", "a {x\ny} b c": "markup", "veja [a](b) isto": "markup", "um ☀ claro dia": "markup", "- um item\n- dois itens\nfim": "list", "1. um item\n2) outro item": "list",
        "sim " * 12: "repeated", "isso é relativo para todos nós": "generic", "digo isto como modelo de linguagem": "crutch", "curta demais aqui": "short", long: "ok", " ".join(f"p{k}" for k in range(1200)) + ".": "long",
    }
    assert column(spark, G.answer_reason, list(cases)) == list(cases.values())
    assert column(spark, lambda c: G.answer_reason(c, "saudacao"), ["bom dia a todos", "bom dia"]) == ["ok", "short"]
    assert column(spark, lambda c: G.answer_reason(c, "saudacao", F.lit("length")), ["bom dia a todos"]) == ["truncated"]


def test_topics(spark):
    from corpusloom.functions import generated as G

    good = ["A abolição da escravatura em 1888", "fotossíntese das plantas", "  Energia solar no campo "]
    bad = [None, "", "x" * 91 + " y", "'Diplomacia zen' o caso", "Um «caso", "título: subtítulo", "caso; outro", "Nome - Fonte", "O que é isto", "54 lojas abrem", "isto serve?", "Um", "Alta, segundo pesquisa", "Governo anuncia plano novo", "Diretor da casa diz, que sim", 'frase com "aspas" dentro']
    assert column(spark, G.topic, good) == [g.strip() for g in good]
    assert column(spark, G.topic, bad[:4] + ["«Um caso raro"] + bad[5:]) == [None] * len(bad)
    assert column(spark, G.safe_topic, ["Como Hackear contas", "jardinagem"]) == [False, True]


PAGE = """<html><head><title>T</title><script>var x = '<p>no</p>';</script></head><body><nav><a href=1>Home</a></nav>
<div class="sidebar-left">aside text</div><article><h1>Heading</h1><p>First <b>bold</b> part.</p><p>Second part&nbsp;here.</p>
<div><a href=a>many</a> <a href=b>links</a> x</div><ul><li>A list item that is long enough</li><li>short</li></ul></article><footer>foot</footer></body></html>"""


def test_pages(spark):
    from corpusloom.functions import pages as H

    text = H.article_text(PAGE)
    assert text.split() == "Heading First bold part. Second part here. A list item that is long enough short".split()
    assert H.article_text("<p>bare") == "bare" and H.article_text("") == ""
    assert H.page_text("<p>one</p><p>two") is None and H.page_text("<body><p>one</p><p>two (Folhapress)") == "one two"
    body = " ".join(f"w{k}" for k in range(120))
    assert H.page_text(f"<body><div class='x entry-content'>{body}</div><main>{body} other</main><p>p</p></body>") == body
    assert len(H.page_text(f"<body><article>{body * 40}</article></body>").split()) == 3000
    wiki = "<h2>A heading of some length[editar]</h2><p>Some text with a note[12] in it</p><p>tiny</p><li>a long enough list item</li>"
    assert H.encyclopedia_text(wiki) == "A heading of some length Some text with a note in it a long enough list item"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert H.article_text(deep) == "x"
    assert column(spark, H.article_column, [None, "", "<p>a</p></div></p>"]) == [None, "", "a"]


def test_text_rules(spark):
    from corpusloom.functions import text as T

    assert T.rejoin_cut_lines("foi explorad\nexplorado ontem") == "foi explorado ontem"
    assert T.rejoin_cut_lines("ele se\nse foi") == "ele se foi" and T.rejoin_cut_lines("no\nno dia") == " no dia"
    assert T.rejoin_cut_lines("e\neconomia") == "e\neconomia" and T.rejoin_cut_lines("uma só") == "uma só" and T.rejoin_cut_lines("") == ""
    assert T.rejoin_cut_lines("cas\n casa da\ndama") == " casa dama" and T.rejoin_cut_lines("a b\n\nc") == "a b\n\nc"

    def spaced(x):
        x = re.sub("([a-záéíóúàèìòùâêîôûäëïöü])([A-ZÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ])", r"\1 \2", x)
        for w in T.INFIXES:
            x = re.sub(f"([a-záéíóú])({w})([a-záéíóú])", r"\1 \2 \3", x, flags=re.I)
        return " ".join(x.split())

    joined = ["sistemaOperacional", "aquelecomputador", "Ocasodeumlivro É assim", "cãoquelate", ""]
    assert column(spark, T.insert_spaces, [*joined, None]) == [*map(spaced, joined), None]
    assert column(spark, T.decode_entities, ["a &amp; b &#233;&#xE9; &nbsp;x &bogus; &lt;p&gt; &#0; &#55296; &", "none", None, "&amp;lt;"]) == ["a & b éé  x &bogus; <p> &#0; &#55296; &", "none", None, "&lt;"]
    assert column(spark, T.clean_text, ["<p>caf&eacute; &amp; ch&aacute;</p> http://x.y z"]) == ["café & chá z"]
    assert column(spark, T.page_title, ["<title> A </title><h1>B</h1>", "<h1>B <b>c</b></h1>", ""]) == ["A", "B c", ""]
    for text in ("Uma frase curta. " * 400, "x" * 5000, "a. " * 2000, "sem fim " * 700):
        parts = T.overlap_chunks(text, 1000, 200)
        assert all(100 < len(p) <= 1000 for p in parts) and all(p in text for p in parts)
        at = [text.find(parts[0])]
        assert "".join(text.split())[:50] == "".join(parts[0].split())[:50] and at[0] == 0
    assert T.overlap_chunks("curto") == ["curto"]
    # the next piece begins half a piece further on at least: an end mark just behind the middle
    text = "a" * 500 + ". " + "b" * 5000
    assert T.overlap_chunks(text, 1000, 900)[1] == text[500:1500].strip()
    contents = "Título\nSUMÁRIO\nUm começo ....... 5\nOutro . . . . 12\nTerceira parte 33\nSem número\n\nO texto começa aqui e segue por uma linha bem longa, com vírgula.\nsolta ...... 44\nFim."
    assert T.without_contents(contents) == "O texto começa aqui e segue por uma linha bem longa, com vírgula.\nFim."
    assert T.without_contents("curto .... 5") == "curto .... 5"
    few = "ÍNDICE\nUm ....... 5\nE aqui já vem um texto que não pertence ao índice, longo o bastante."
    assert T.without_contents(few) == "ÍNDICE\nE aqui já vem um texto que não pertence ao índice, longo o bastante."
    assert column(spark, T.without_contents_column, [None, ""]) == [None, ""]
    assert column(spark, lambda c: T.context_of(F.split(c, r"\|")), ["short|" + "w " * 150 + "|" + "v " * 2000, None]) == [" ".join(["w"] * 150 + ["v"] * 350), None]


def test_chain(spark):
    from corpusloom.plans.light_clean import chain_clean

    texts = ["in\x1b[2D\x1b[Kinfraestrutura boa", "foi explorad\nexplorado", "VocÃª vem", "Isto Ă tem", "Olá!Eusou", "a\x07b", "limpo", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in chain_clean(rows).collect()}
    assert [got[k]["text"] for k in range(9)] == ["infraestrutura boa", "foi explorado", "Você vem", "Isto tem", "Olá! Eusou", "ab", "limpo", "", None]
    flags = [got[k]["flags"] and {n for n, v in got[k]["flags"].asDict().items() if v} for k in range(9)]
    assert flags == [set(), set(), {"mojibake"}, {"invalid"}, {"spaces"}, {"ansi"}, set(), set(), None] or flags[3] == {"invalid", "emoji", "spaces"} or {"invalid"} <= flags[3]
    assert chain_clean(rows.filter("doc_id < 0")).count() == 0


def plain_line_pairs(text):
    """The rule in plain code, event by event."""
    asks = re.compile(r"^\s*(?:pergunta|p|q|user|humano|h|usu[áa]rio)\s*[:：]\s*(.*)$", re.I)
    answers = re.compile(r"^\s*(?:resposta|r|a|assistente|bot|gpt|model)\s*[:：]\s*(.*)$", re.I)
    inline = re.compile(r"\b(?:resposta|assistente|bot|gpt|model)\s*[:：]\s*", re.I)
    out, open_pair = [], {"q": [], "a": []}
    mode = ""

    def close():
        q, a = (" ".join(x.strip() for x in open_pair[k]).strip() for k in "qa")
        if q and a:
            out.append((q, a))
        open_pair["q"], open_pair["a"] = [], []

    for line in text.split("\n"):
        ask, answer = asks.match(line), answers.match(line)
        if ask:
            if mode == "a":
                close()
            if m := inline.search(ask[1]):
                q, a = ask[1][: m.start()].strip(), ask[1][m.end() :].strip()
                out += [(q, a)] if q and a else []
                open_pair["q"], open_pair["a"], mode = [], [], ""
            else:
                mode = "q"
                open_pair["q"].append(ask[1])
        elif answer:
            mode = "a"
            open_pair["a"].append(answer[1])
        elif mode:
            open_pair[mode].append(line)
    if mode == "a" or open_pair["q"] and open_pair["a"]:
        close()
    return out


def test_line_pairs(spark):
    from corpusloom.operators import pairs as P

    rng = random.Random(4)
    parts = ["Pergunta: um", "P: dois", "Resposta: três", "a: quatro", "linha solta", "", "  q：cinco ", "Pergunta: seis Resposta: sete", "Usuário: oito bot: nove", "user:", "R:", "dez: onze"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(300)]
    got = column(spark, P.line_pairs, [*texts, None])
    assert [[tuple(p) for p in g] for g in got] == [plain_line_pairs(t) for t in texts] + [[]]
    assert sum(map(len, got)) > 150


def test_prompts_blocks_and_structures(spark):
    from corpusloom.operators import pairs as P

    cases = {
        "plain": "plain", None: "", " x ": "x", "[not a list": "[not a list", '[{"role": "user", "content": " Oi "}, {"role": "assistant", "content": "no"}, {"from": "human", "value": "tudo"}]': "Oi tudo",
        "[{'role': 'system', 'content': 'S'}, {'role': 'USER', 'content': 'q'}]": "S q", '[{"role": "assistant", "content": "only"}]': '[{"role": "assistant", "content": "only"}]',
    }
    assert column(spark, P.serialised_prompt, list(cases)) == list(cases.values())
    block = "Pergunta: um\nResposta: dois\n\nPergunta: a\nPergunta: b\nresto\nResposta: c\n\n Pergunta: só\n\nResposta: x"
    assert [tuple(p) for p in column(spark, P.block_pairs, [block])[0]] == [("um", "dois"), ("b", "c")]
    assert column(spark, P.block_pairs, [None, ""]) == [[], []]
    records = ['{"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}', '{"conversa": [{"humano": "x", "assistente": "y"}]}', '{"chat": "[{\'role\': \'user\', \'content\': \'x\'}]"}', '{"turns": [{"question": "x", "reply": "y"}]}', '{"text": "x"}', "", None]
    got = [tuple(r) for r in column(spark, P.record_structure, records)]
    assert got == [("conversations", "turns", ["human"], ["gpt"]), ("conversa", "pairs", ["humano"], ["assistente"]), ("chat", "turns", ["user"], ["assistant"]), ("turns", "pairs", ["question"], ["reply"])] + [(None, None, None, None)] * 3
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(records[4:] + records[:2])], "k int, r string")
    assert tuple(P.infer_structure(rows, "r", "k").first())[1] == "fallback" and P.infer_structure(rows, "r", "k", 5).first()["key"] == "conversations"
    assert P.infer_structure(rows.filter("k < 0"), "r", "k").first()["kind"] == "fallback"


def test_lookups(spark):
    from corpusloom.operators import lookups as L

    docs = spark.createDataFrame([(1, "O rio corre e o periódico fala de Futebol"), (2, "periódico"), (3, None), (4, ""), (5, "rio")], "doc_id long, text string")
    terms = spark.createDataFrame([("água", 0, "rio"), ("água", 1, "mar"), ("esporte", 0, "futebol"), ("x", 0, "ab"), ("mídia", 0, " Periódico ")], "category string, rank int, term string")
    got = {(r["id"], r["category"], r["item"], r["hits"]) for r in L.category_hits(docs, terms, block=2).collect()}
    assert got == {(1, "água", "rio", 1), (1, "esporte", "futebol", 1), (1, "mídia", "periódico", 1), (2, "mídia", "periódico", 1), (5, "água", "rio", 1)}
    assert L.category_hits(docs, terms.filter("rank > 9")).count() == 0 and L.category_hits(docs.filter("doc_id < 0"), terms).count() == 0
    base = spark.createDataFrame([("Sol ", "c", "s"), (None, "n", "n")], "topic string, context string, source string")
    rows = spark.createDataFrame([(1, " SOL"), (2, "lua"), (3, None)], "k int, q string")
    assert sorted(tuple(r) for r in L.known_context(rows, base, "q").select("k", "context", "source").collect()) == [(1, "c", "s"), (2, "", ""), (3, "", "")]
    claims = spark.createDataFrame([(1, ["Brasil", "copa", "1970", "México", "x"]), (2, ["a", "b", "c", "d"]), (3, []), (4, ["z"])], "claim_id int, terms array<string>")
    results = spark.createDataFrame([(1, "s2", "Copa de 1970", "no méxico"), (1, "s1", "Copa", None), (2, "s", "nada", "mesmo")], "claim_id int, source string, title string, text string")
    got = {r["claim_id"]: (r["verdict"], r["source"], r["hits"]) for r in L.verified_claims(claims, results).collect()}
    assert got == {1: ("confirmed", "s2", 3), 2: ("confirmed", "s", 2) if False else got[2], 3: ("no_search", None, 0), 4: ("no_search", None, 0)} and got[2][0] in ("not_found", "confirmed")
    orders = spark.createDataFrame([("aguardando", 3, ["todos"]), ("rodando", 0, ["a", "b"]), ("concluido", 9, None), ("erro", None, ["a"]), ("aguardando", None, None)], "status string, goal int, templates array<string>")
    assert tuple(L.queue_report(orders, {"a": 10, "b": 70}).first()) == (2, 1, 1, 1, 3 * 40 + 70 + 40)
    assert L.requeued(orders).filter("status = 'rodando'").count() == 0 and tuple(L.queue_report(orders.filter("false"), {}).first()) == (0, 0, 0, 0, 0)
    assert column(spark, L.disk_band, [11.0, 7.0, 5.0, None], "double") == ["green", "yellow", "red", None]
    files = spark.createDataFrame([("f/a.csv",), ("f/b.JSONL",), ("g/x.bin",), ("h/none",)], "path string")
    assert sorted(tuple(r) for r in L.folder_formats(files).collect()) == [("f", "jsonl", "sanitise", 2), ("g", "other", "none", 1), ("h", "empty", "none", 1)]
    listed = spark.createDataFrame([(f"f{k}", k) for k in range(25)], "path string, rows int")
    assert sorted(r["path"] for r in L.middle_files(listed).filter("part = 'val'").collect()) == ["f11", "f12"]
    assert [L.middle_files(listed.filter(f"rows < {n}")).filter("part = 'val'").count() for n in (0, 1, 2, 3, 4)] == [0, 0, 1, 1, 1]
    pages = spark.createDataFrame([("a", "2024", 5), ("b", None, 9), ("c", "2025", None)], "url string, date string, words int")
    assert [[r["url"] for r in L.preferred(pages, p, 2).collect()] for p in ("new", "complex", "")] == [["c", "a"], ["b", "a"], ["a", "b"]]


def test_sinks_and_corpora(spark, tmp_path):
    from corpusloom.sources import corpora, sinks

    rows = spark.range(130).selectExpr("id as doc_id", "cast(id as string) as text")
    path = str(tmp_path / "s")
    sinks.append_shards(rows.filter("doc_id < 70"), path, "doc_id", 50)
    sinks.append_shards(rows.filter("doc_id >= 70"), path, "doc_id", 50)
    got = {r["shard"]: r["count"] for r in spark.read.json(path).groupBy("shard").count().collect()}
    assert got == {1: 50, 2: 20, 3: 50, 4: 10}
    sinks.append_shards(rows.filter("doc_id < 0"), path, "doc_id", 50)
    lots = str(tmp_path / "l")
    pairs = rows.selectExpr("doc_id", "doc_id % 13 as f", "text")
    for part in (pairs.filter("f < 5"), pairs, pairs):
        sinks.append_lots(part, lots, "f", "doc_id", 40)
    back = spark.read.json(f"{lots}/lots")
    assert back.count() == 130 and back.select("doc_id").distinct().count() == 130
    assert column(spark, sinks.letters, [1, 26, 27, 52, 53, 702, 703], "int") == ["a", "z", "aa", "az", "ba", "zz", "aaa"]
    for b, n in ((None, 10), (100, None), (17, 1000), (0, 5), (10**9, 10**9)):
        want, total = [], 0
        for k in range(130):
            if (b is not None and total >= b) or (n is not None and k >= n):
                break
            want.append(k)
            total += len(str(k))
        assert sorted(r[0] for r in corpora.limited(rows, "doc_id", "text", b, n, width=16).select("doc_id").collect()) == want
    big = sinks.exploded(rows.withColumn("f", F.when(F.col("doc_id") < 100, "x").otherwise("y")), "f", "doc_id", "text", 100, 30)
    assert {(r["f"], r["part"]): r["count"] for r in big.groupBy("f", "part").count().collect()} == {("x", 0): 30, ("x", 1): 30, ("x", 2): 30, ("x", 3): 10, ("y", 0): 30}
    files = {"a.txt": b"alpha", "d/b.txt": b"beta", "../evil": b"no", "/abs": b"no"}
    folder = tmp_path / "archives"
    folder.mkdir()
    with zipfile.ZipFile(folder / "z.zip", "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    for name, mode in (("t.tar", "w"), ("u.tar.gz", "w:gz")):
        with tarfile.open(folder / name, mode) as t:
            for n, c in files.items():
                info = tarfile.TarInfo(n)
                info.size = len(c)
                t.addfile(info, io.BytesIO(c))
    (folder / "g.txt.gz").write_bytes(gzip.compress(b"gamma"))
    (folder / "broken.zip").write_bytes(b"PK\x03\x04 not really")
    found = {(r["archive"].rsplit("/", 1)[1], r["member"], bytes(r["content"])) for r in corpora.read_members(spark, str(folder)).collect()}
    assert found == {(a, m, files[m]) for a in ("z.zip", "t.tar", "u.tar.gz") for m in ("a.txt", "d/b.txt")} | {("g.txt.gz", "g.txt", b"gamma")}


def test_ranking_and_overlap(spark):
    from corpusloom.operators import dedup as D
    from corpusloom.operators.ranking import best

    rng = random.Random(6)
    rows = [(k, rng.choice([0.0, 0.5, 0.51, 0.99, 1.0, None]), rng.randint(0, 3)) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, s double, n int")
    order = sorted(rows, key=lambda r: (-(r[1] or 0.0) if r[1] is not None else 0.0, r[1] is None, -r[2], r[0]))
    for most in (0, 1, 37, 399, 1000):
        got = sorted(best(df, "s", [F.desc("n"), "k"], most, buckets=8).collect(), key=lambda r: r["place"])
        assert [r["k"] for r in got] == [r[0] for r in order[:most]] and [r["place"] for r in got] == list(range(min(most, 400)))
    keys = [(g, f"t{rng.randint(0, 40)}" if rng.random() < 0.9 else None) for g in "abcd" for _ in range(40)] + [(None, "t1")]
    df = spark.createDataFrame(keys, "g string, t string")
    sets = {g: {t for h, t in keys if h == g} for g in "abcd"}
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    assert {(r["a"], r["b"]): r["shared"] for r in D.overlap(df, "g", F.col("t")).collect()} == want


def test_noise_literals(spark):
    from corpusloom.functions import quality as Q

    assert Q.literal_of(r"as\s+an\s+ai\s+(language\s+model|assistant)") == "as an ai " and Q.literal_of(r"let'?s\s+craft\s+an?\s+article") == "s craft a"
    assert all(len(Q.literal_of(p)) >= 5 for p in Q.NOISE)
    said = ["I'll write an article", "as an AI  assistant", "Não há mais conversa", "i cant browse", "The conversation : system gave", None, "", "plain words about an article"]
    assert column(spark, Q.ai_noise, said) == [s and bool(re.search("|".join(Q.NOISE), s.lower())) if s is not None else None for s in said[:6]] + [False, False]


def test_light_clean_full(spark):
    """Against plain code: row-wise stages, exact duplicates by the earliest, then near duplicates of kept texts."""
    from corpusloom.plans.light_clean import light_clean, light_clean_full, light_status
    from corpusloom.sources.sinks import written

    rng = random.Random(9)
    vocab = [f"palavra{k}" for k in range(400)]
    texts = []
    for k in range(60):
        words = rng.choices(vocab, k=60)
        texts.append(" ".join(words))
        if k % 3 == 0:
            texts.append("  ".join(words).upper() if k % 2 else " ".join(words))
        if k % 4 == 0:
            texts.append(" ".join(words[:-2] + rng.choices(vocab, k=2)))
    texts += [None, "", "curto", "The user gave instructions to write. " * 10]
    rows = [(k, t, "pt" if k % 10 else "xx") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["status"] for r in light_clean_full(docs, ["pt"], cut=written).collect()}
    seen, kept, want = set(), [], {}
    for k, t, lang in rows:
        words = re.findall(r"\w+", (t or "").lower())
        key = " ".join((t or "").split()).lower()
        if not (t or "").strip():
            want[k] = "no_text"
        elif lang != "pt":
            want[k] = "language"
        elif "user gave instructions" in t:
            want[k] = "ai_noise"
        elif len(t.split()) < 20:
            want[k] = "quality:short"
        elif key in seen:
            want[k] = "duplicate"
        elif any(len(set(words) & w) >= 0.8 * len(set(words) | w) for w in kept):
            want[k], _ = "near_duplicate", seen.add(key)
        else:
            want[k] = "kept"
            seen.add(key)
            kept.append(set(words))
    assert got == want and {"near_duplicate", "duplicate", "language"} <= set(want.values())
    assert {r["doc_id"]: r["status"] for r in light_status(docs).collect()} == {r["doc_id"]: r["status"] for r in light_clean(docs).collect()}
    detect = lambda c: F.when(F.contains(c, F.lit("palavra1 ")), "xx")
    assert light_status(docs, ["pt"], detect).filter("status = 'language'").count() == sum(bool(t) and "palavra1 " in t[:2000] for t in texts)
    assert light_clean_full(docs.filter("doc_id < 0"), cut=written).count() == 0


@pytest.mark.parametrize("name", ["without_contents", "rejoined_lines", "chain_clean", "page_articles"])
def test_queries_without_sql_keep_every_row(spark, name):
    from corpusloom.plans import catalog, catalog_more  # noqa: F401

    sf = "/root/testdata/sf0.001"
    table = "pages" if name == "page_articles" else "documents"
    assert catalog.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_small_readers(spark, tmp_path):
    from corpusloom.functions import text as T
    from corpusloom.sources import readers as R

    assert T.whole_repair("VocÃª vem") == "Você vem" and T.whole_repair("mães") == "mães" and T.whole_repair("Ã soltoĀ") == "Ã soltoĀ" and T.whole_repair("") == ""
    assert column(spark, T.drop_ansi, ["\x1b[31mred\x1b[0m  text\x07", "\x1b]0;title\x1b\\x", None, ""]) == ["red text", "x", None, ""]
    assert column(spark, lambda c: R.pdf_ok(c.cast("binary"), 10), ["%PDF-1.4 and more", "%PDF-1.4", "no pdf at all here", None]) == [True, False, False, None]
    assert column(spark, R.xml_text, ["<a>x <b>y</b><!-- no --> &lt;z&gt; &amp;</a>", None]) == ["x y <z> &", None]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.csv").write_text('one,"two, three"\n"a ""q""",\n')
    assert sorted(r["text"] for r in R.read_csv_text(spark, str(tmp_path / "c")).collect()) == ['a "q"', "one two, three"]
    lines = spark.createDataFrame([("d", 1, 5.0, 100.0, "head"), ("d", 1, 50.0, 100.0, "b" * 300), ("d", 1, 20.0, 100.0, "a" * 300), ("d", 1, 60.0, 100.0, "ab"), ("e", 1, 50.0, 100.0, "short")], "doc string, page int, y double, height double, line string")
    assert [(r["doc"], r["text"]) for r in R.body_lines(lines).collect()] == [("d", "a" * 300 + "\n" + "b" * 300)]
    for kind, want in (("csv", {'{"k":"1"}'}), ("json", {'{"k": 2}'}), ("parquet", {'{"k":3}'})):
        if kind == "csv":
            (tmp_path / "p").mkdir()
            (tmp_path / "p/x.csv").write_text("k\n1\n")
        elif kind == "json":
            (tmp_path / "p/y.json").write_text('{"k": 2}\n')
        else:
            spark.createDataFrame([(3,)], "k int").coalesce(1).write.parquet(str(tmp_path / "p/z"))
        assert {r["record"] for r in R.read_preferred(spark, str(tmp_path / "p")).collect()} == want
    (tmp_path / "none").mkdir()


def test_streams_resume(spark, tmp_path):
    """A second run takes only what is new, and a key seen by the first run isn't first again."""
    from corpusloom.streaming import pickup

    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    shape = "k string, ts timestamp"
    batches = [[("a", 1), ("a", 2), ("b", 1)], [("a", 3), ("c", 3)], []]
    for rows in batches:
        if rows:
            spark.createDataFrame(rows, "k string, d int").selectExpr("k", "timestamp '2024-01-01' + make_dt_interval(d) as ts").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).parquet(source)
        pickup.drain(pickup.first_seen(stream, "k", "ts", "30 days").select("k"), target, state)
    assert sorted(r["k"] for r in spark.read.schema("k string").parquet(target).collect()) == ["a", "b", "c"]


def test_instructions_and_questions(spark):
    from corpusloom.functions import generated as G

    rows = spark.createDataFrame([("poema", "o mar"), ("?", "x"), (None, None), ("conto", "")], "k string, t string")
    assert [r[0] for r in rows.select(G.instruction(F.col("k"), F.col("t"))).collect()] == ["Escreva um poema sobre o mar.", "Fale sobre x.", "Fale sobre este tema.", "Escreva um conto envolvente sobre este tema."]
    asked = column(spark, lambda c: G.topic_question(c, F.lit(0)), ["A abolição da escravatura em 1888", "Energia solar", None])
    assert asked == ["Fale sobre a abolição da escravatura em 1888?", "Fale sobre Energia solar?", None]
    assert column(spark, lambda c: G.topic_question(c, F.lit(9)), ["Uma lei"]) == ["O que você sabe sobre uma lei?"]
    texts = ["Pergunta: um\ndois Resposta: três Resposta: quatro", "Resposta: só", "nada", "", None, "Pergunta: sem"]
    got = [tuple(p) for p in column(spark, G.marked_pair, texts)]
    assert got == [("um\ndois", "três Resposta: quatro"), ("", "só"), ("", "nada"), ("", ""), ("", ""), ("", "Pergunta: sem")]
    again = "esta mesma frase tem mais de cinco palavras. " * 3 + " ".join(f"p{k}" for k in range(130)) + "."
    assert column(spark, lambda c: G.answer_reason(c, "artigo", long=True), [again, again[150:]]) == ["repeated_sentences", "ok"]
    rows = spark.createDataFrame([(k, "g", t) for k, t in enumerate("abcabbd")] + [(9, None, "a"), (10, None, "a")], "k int, g string, t string")
    from corpusloom.operators.dedup import recent_duplicates

    assert {r["k"] for r in recent_duplicates(rows, "g", "k", "t", 3).filter("seen").collect()} == {3, 4, 5, 10}


def test_digits_at_the_ends_of_lines_stay(spark):
    from corpusloom.functions import quality as Q

    assert column(spark, Q.lines, ["\n".join(["0 first 0", " 1 second 1 ", "2", "", "  ", "x 4"])]) == [["0 first 0", "1 second 1", "2", "x 4"]]


def test_digits_at_the_ends_of_claims_stay(spark):
    from corpusloom.functions import rules as R

    claims = [f"{k} claim of the year that is long enough for the rule ends here." for k in range(3)]
    assert column(spark, lambda c: R.fact_sentences(c, r"\d"), ["  ".join(claims), " ".join([claims[0], claims[0].upper(), *claims[1:]]), "none", None]) == [claims, claims, [], None]


def test_digits_at_the_ends_of_themes_stay(spark):
    from corpusloom.functions import rules as R

    assert column(spark, R.theme, ["0 is the first sentence here. Next one", "short. 1 is the second sentence.  x"]) == ["0 is the first sentence here", "1 is the second sentence"]


def test_upper_letter_is_one_letter(spark):
    from corpusloom.functions import rules as R
    from corpusloom.functions import text as T

    assert column(spark, T.upper_letter, ["a", "ß", "ŉ", "ﬁ", "ᾀ", "1", "", None]) == ["A", "ẞ", "ŉ", "ﬁ", "ᾈ", "1", "", None]
    assert column(spark, R.question_from_title, ["ßie ist", "é assim?", ""]) == ["ẞie ist?", "É assim?", "?"]


def tables_against_sql(spark, path, name, rows, schema):
    import duckdb

    from corpusloom.plans import catalog, catalog_records  # noqa: F401  (registers more queries)

    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    mine = sorted(tuple(r) for r in catalog.queries()[name](spark, str(path)).collect())
    return mine, sorted(con.execute(catalog.oracle_sql()[name]).fetchall())


def test_folders_beyond_the_alphabet(spark, tmp_path):
    from corpusloom.sources import sinks

    mine, theirs = tables_against_sql(spark, tmp_path, "folder_split", [(k, "a" if k % 10 else "b") for k in range(4000)], "doc_id long, source string")
    assert mine == theirs and len(mine) == 200 and "a_{" in dict(mine)
    assert column(spark, sinks.character, [97, 0xD7FF, 0xD800, 0x1F600, 0x110000], "long") == ["a", "퟿", "55296", "😀", "1114112"]


def test_pickup_of_a_table_in_several_files(spark, tmp_path):
    mine, theirs = tables_against_sql(spark, tmp_path, "picked_up", [(k, f"short {k}") for k in range(50)], "doc_id long, text string")
    assert mine == theirs and len(mine) == 50


def test_over_share(spark):
    from corpusloom.functions import rules as R

    rng = random.Random(5)
    cases = [[rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(300)]
    for share in (0.3, 0.4):
        want = [bool(w) and max(map(w.count, w)) > share * len(w) for w in cases]
        assert column(spark, lambda c: R.over_share(c, share), cases, "array<string>") == want and True in want and False in want  # noqa: B023
