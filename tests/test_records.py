"""Unit cases for rules, records, readers, sinks and streaming."""

import json

import pytest
from pyspark.sql import functions as F


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()[0]


def test_rules(spark):
    from corpusloom.functions import rules as R

    assert one(spark, R.approved, "Aprovaço") is True
    assert one(spark, R.approved, "não aprovado") is False
    assert one(spark, R.trimmed_article, "Claro! Segue\n\ncorpo um\ncorpo dois\nEspero que goste") == "corpo um\ncorpo dois"
    assert one(spark, R.trimmed_article, "Claro!\n\n") == ""
    assert one(spark, lambda c: R.most_common(R.split_words(c)), "a b a c a") == 3
    assert one(spark, R.bulk_reason, "x x x x x x x x x x x x x x x x x") == "repeated_word"
    assert one(spark, R.invalid_reason, "Pergunta: por que isso acontece assim?") == "no_answer"
    assert one(spark, R.invalid_reason, None) == "short"
    qa = one(spark, R.question_answer, "Pergunta: Quem foi? Resposta: Foi ele.")
    assert (qa["question"], qa["answer"]) == ("Quem foi?", "Foi ele.")
    qa = one(spark, R.question_answer, "Usuário: oi tudo bem\nAssistente: tudo ótimo")
    assert qa["answer"] == "tudo ótimo"
    assert one(spark, R.question_answer, "nada aqui") is None
    assert one(spark, R.book_text, "Era uma vez\n12\nxiv\nwww.site.com\num rei 02/10/14 17:10") == "Era uma vez um rei"
    assert one(spark, lambda c: F.size(R.chapters(c)), "prefácio\nCapítulo 1\num\nCapítulo 2\ndois") == 3
    assert one(spark, R.question_from_title, "como fazer pão - Meu Site") == "Como fazer pão?"
    assert one(spark, lambda c: R.variety(c)["guess"], "o autocarro e o comboio") == "pt"
    ids = spark.createDataFrame([([0, 0],), ([1, 2, 3],), ([1, 0, 2],), ([5] * 8,), ([1, 2, 0, 0],)], "x array<long>")
    assert [r[0] for r in ids.select(R.repetitive_ids(F.col("x"), 0)).collect()] == [True, False, True, True, False]


@pytest.mark.parametrize(
    ("record", "n"),
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, 2),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, 2),
        ({"conversations": json.dumps([{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}])}, 2),
        ({"chat": ["a", "b", "c"]}, 3),
        ({"instruction": "a", "input": "x", "output": "b"}, 2),
        ({"prompt": "a", "completion": "b"}, 2),
        ({"messages": [{"role": "user", "content": "a"}]}, None),
        ({"text": "plain"}, None),
    ],
)
def test_record_shapes(spark, record, n):
    from corpusloom.operators import examples as E

    found = one(spark, E.record_messages, json.dumps(record))
    assert (found and len(found)) == n
    assert (found or [])[:1] == [] or found[0]["role"] == "user"


def test_training_rows(spark):
    from corpusloom.operators import examples as E

    data = [(1, [("user", "ab"), ("assistant", "cd")]), (2, [("user", "ab")]), (3, [("user", "x" * 20), ("assistant", "cd")])]
    df = spark.createDataFrame(data, "id long, messages array<struct<role:string,content:string>>")
    got = {r["id"]: (r["ids"], r["labels"]) for r in E.training_rows(df, lambda t: [ord(c) for c in t], 1, 2, 3, 0, 8).collect()}
    assert got[1] == ([1, 97, 98, 3, 99, 100, 2, 0], [-100] * 4 + [99, 100, -100, -100])
    assert 2 not in got and got[3][0][-3:] == [99, 100, 2] and len(got[3][0]) == 8


def test_readers(spark, tmp_path):
    from corpusloom.sources import readers

    lines = ['﻿{"text": "um"}', "", "   ", "{bad", "[1]", '[{"text": "dois"}, {"text": "três"}]', '{"text": "' + "x" * 600_000 + '"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = {r["reason"]: r["n"] for r in readers.read_lines(spark, str(tmp_path)).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert got == {None: 1, "blank": 2, "bad_json": 1, "not_object": 2, "too_long": 1}
    assert sorted(json.loads(r["record"])["text"] for r in readers.read_records(spark, str(tmp_path)).collect()) == ["dois", "três", "um"]
    (tmp_path / "b.txt").write_bytes("ação".encode("latin-1"))
    (tmp_path / "c.html").write_text("<script>x</script><p>Olá</p>")
    texts = {r["kind"]: r["text"] for r in readers.read_any(spark, str(tmp_path)).collect()}
    assert (texts["txt"], texts["html"], texts["jsonl"]) == ("ação", "Olá", None)
    assert readers.read_documents(spark, str(tmp_path)).count() == 4
    (tmp_path / "w.lst").write_text("# list\nUm\num\n\nDois\n")
    assert sorted(r[0] for r in readers.read_words(spark, str(tmp_path / "w.lst")).collect()) == ["dois", "um"]


def test_sinks(spark, tmp_path):
    from corpusloom.sources import sinks

    df = spark.range(2500).select(F.col("id"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("g"))
    sizes = sinks.sharded(df, "g", "id", 300).groupBy("g", "shard").count().collect()
    assert sorted(r["count"] for r in sizes if r["g"] == "a") == [200] + [300] * 6
    wide = sinks.placed(df, "g", "id", width=64).orderBy("g", "id").collect()
    assert [r["place"] for r in wide if r["g"] == "b"] == list(range(500))


def test_stream_resumes(spark, tmp_path):
    from corpusloom.streaming.pickup import pick_up

    for k in range(2):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(str(tmp_path / "in"))
        pick_up(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "id long", lambda d: d)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_near_duplicates_against_brute_force(spark):
    import random

    from corpusloom.operators.dedup import minhash_near
    from corpusloom.sources.sinks import written

    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = rng.sample(vocab, 60)
        texts.append(base)
        texts += [base[:-1] + [rng.choice(vocab)] for _ in range(4)]  # near copies
    texts += [texts[0], list(reversed(texts[0])), []]
    data = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, None)]
    df = spark.createDataFrame(data, "id long, text string").repartition(3)
    got = {r["id"]: r["duplicate_of"] for r in minhash_near(df, F.col("text"), "id", cut=written).collect()}
    kept, want = [], set()
    for k, t in enumerate(texts):
        near = [j for j in kept if len(set(t) & set(texts[j])) >= 0.8 * len(set(t) | set(texts[j]))] if t else []
        (want.add(k) if near else kept.append(k))
    assert set(got) <= want and len(want - set(got)) <= len(want) // 50  # banding finds a pair of 0.95 with all but certainty
    assert all(got[k] in kept for k in got)
    assert minhash_near(df.filter("id < 0"), F.col("text"), "id", cut=written).count() == 0
