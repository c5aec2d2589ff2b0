"""Each operator on small fixtures: against brute force, a library or an exact round trip, with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

SF = "/root/testdata/sf0.001"
ODD = [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one"), (None, "one two three"), (105, "Ünï ΑΣ 'tis <|endoftext|> x\x00y")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeéou") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = words(70)
    rows = [(k, " ".join(words(rng.randint(1, 200)))) for k in range(30)]
    rows += [(30 + k, " ".join(words(20) + passage + words(20))) for k in range(6)]
    base = words(180)
    for k in range(6):
        copy = list(base)
        copy[30 * k] = "changed"
        rows.append((40 + k, "  ".join(copy) if k % 2 else " ".join(copy)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, "Was " * 150), (53, "long " + " ".join(words(30_000)))]
    return rows + ODD


def frame(spark, rows):
    """With extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, kept string, fp long, group_size long").repartition(3)


def empty(spark):
    return frame(spark, [(1, "x")]).filter("doc_id < 0")


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_exact(spark, corpus):
    from corpusloom.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in corpus:
        groups[norm(t)].append(i)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, first[norm(t)], len(groups[norm(t)]), i == first[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in corpus), key=lambda r: (r[0] is None, r))
    assert by_id(exact_dedup(frame(spark, corpus)), "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup(empty(spark)).count() == 0


def test_simhash(spark, corpus):
    from corpusloom.llm.simhash import links, simhash, simhash_groups, sparse, walk

    def plain(t):
        ws = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        parts = [b" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64)) if hs else 0

    short = corpus
    assert all(simhash((t or "").encode()) == plain(t) for _, t in short)
    rng = np.random.default_rng(1)
    x = np.unique(np.concatenate([y := rng.integers(0, 1 << 63, 300, dtype=np.uint64), y ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)), y ^ np.uint64(5)]))
    i, j = walk(x, None, 2)
    want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if int(x[a] ^ x[b]).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want
    i, j = walk(x, None, 2, frontier=64)
    assert len(i) == len(want) and {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want
    i, j = walk(x[:300], x[300:], 2)
    assert {(a, b + 300) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a, b in want if a < 300 <= b}
    fps = spark.createDataFrame([(t, int(f)) for t in (0, 1) for f in x.view(np.int64)[t::2]], "t int, fp long")
    for cell in (1 << 14, 30, 2):  # one task, node pairs of some depth, crowded nodes
        found = [(r["t"], *sorted((r["u"], r["v"]))) for r in links(fps, 2, cell=cell, keep=lambda x, i, j: np.arange(len(i))).collect()]
        assert len(found) == len(set(found)) and set(found) == {(a % 2, *sorted(map(int, (x[a].view(np.int64), x[b].view(np.int64))))) for a, b in want if a % 2 == b % 2}
    i, j = walk(x, None, 2)
    for few in (0, 1, 16):
        kept = sparse(x, i, j, few)
        degree = Counter(k for p in want for k in p)
        some = {tuple(sorted(p)) for p in zip(i[kept].tolist(), j[kept].tolist(), strict=True)}
        assert some <= want and {p for p in want if min(degree[p[0]], degree[p[1]]) <= few} <= some
        root = list(range(len(x)))
        for part in (some, want):
            groups = list(range(len(x)))
            for _ in range(12):
                for a, b in part:
                    groups[a] = groups[b] = min(groups[a], groups[b])
            root, last = groups, root
        assert root == last
    got = simhash_groups(frame(spark, short), cell=4).collect()
    fps = {(r["doc_id"]): int(r["fingerprint"], 16) for r in got if r["doc_id"] is not None}
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == root
    assert len(got) == len(short) and simhash_groups(empty(spark)).count() == 0


def test_components(spark):
    from corpusloom.llm.common import components

    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 7), (200, 201), (201, 202), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 1, 200: 200, 201: 200, 202: 200}


def plain_words_dedup(rows):
    first, want = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for k in range(len(ws) - 49):
            if i is not None and first.setdefault(tuple(ws[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)).hexdigest()))
    return want


def plain_bytes_dedup(rows):
    count = Counter(b[k : k + 200] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - 199))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone, upto = bytearray(len(b)), 0
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[max(k, upto) : k + 200] = b"\1" * (k + 200 - max(k, upto))
                upto = k + 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(want, key=lambda r: (r[0] is None, r))


def crowded_rows(n=60):
    """A passage that every row has, in contexts of its own: one anchor in all rows."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    passage = words(75)
    return [(k, " ".join(words(rng.randint(5, 40)) + passage + words(rng.randint(5, 40)))) for k in range(n)] + [(n + k, " ".join(passage)) for k in range(3)]


def test_words_dedup(spark, corpus):
    from corpusloom.llm.fm_index import substring_dedup

    want = plain_words_dedup(corpus)
    assert sum(w[2] for w in want) > 300
    cols = ("n_words", "n_removed", "kept_sha256")
    assert by_id(substring_dedup(frame(spark, corpus)), *cols) == want
    assert substring_dedup(empty(spark)).count() == 0
    rows = crowded_rows()
    want = plain_words_dedup(rows)
    for crowd in (2000, 20, 0):  # whole classes, a crowded passage, everything by windows
        assert by_id(substring_dedup(frame(spark, rows), crowd=crowd), *cols) == want


def test_words_dedup_tells_words_apart(spark):
    """Words that collide under every polynomial hash modulo 2^64 (Thue-Morse words) are still different words."""
    from corpusloom.llm.fm_index import substring_dedup

    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    context = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(context[:40] + [x] + context[40:])) for k, x in enumerate((a, b))]
    want = plain_words_dedup(rows)
    assert [w[2] for w in want] == [0, 0]
    assert by_id(substring_dedup(frame(spark, rows)), "n_words", "n_removed", "kept_sha256") == want


def test_bytes_dedup(spark, corpus):
    from corpusloom.llm.suffix_levels import SuffixLevels, suffix_dedup

    want = plain_bytes_dedup(corpus)
    assert sum(w[2] for w in want) > 2000
    cols = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_id(suffix_dedup(frame(spark, corpus)), *cols) == want
    rows = crowded_rows() + [(None, "x y " * 70), (None, "x y " * 70), (7, "q" * 300)]
    for crowd in (2000, 20, 0):
        assert by_id(suffix_dedup(frame(spark, rows), crowd=crowd), *cols) == plain_bytes_dedup(rows)
    text = b"".join(t.encode() for _, t in corpus if t and len(t) < 5000) + bytes(range(30)) * 4
    levels = SuffixLevels(text, 20)
    for k in range(0, len(text) - 19, 700):
        levels.insert(np.arange(k, min(k + 700, len(text) - 19)))
        for starts, lcp in levels.levels:
            x = [text[i : i + 20] for i in starts[:50]]
            assert x == sorted(x) and all(a[:m] == b[:m] and a[m] != b[m] for a, b, m in zip(x, x[1:], lcp[1:50].tolist(), strict=False))
    seen = Counter(text[k : k + 20] for k in range(len(text) - 19))
    assert [bool(h) for h in levels.hit[: len(text) - 19]] == [seen[text[k : k + 20]] > 1 for k in range(len(text) - 19)]
    assert len(levels.levels) <= 2 + (len(text) // 700).bit_length()
    assert suffix_dedup(empty(spark)).count() == 0


def test_suffix_family(spark, corpus, tmp_path):
    """Batches added one after another: ranges add up to those of all documents at once, and levels merge geometrically."""
    from corpusloom.llm.suffix_levels import SuffixFamily, repeated_ranges

    rows = [(i, t) for i, t in corpus if i is not None] + crowded_rows(12)[:6]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    rng = random.Random(1)
    rng.shuffle(rows)
    family, got = SuffixFamily(spark, str(tmp_path / "family"), shards=3, width=60), Counter()

    def windows(ranges):
        return {(r["doc_id"], k) for r in ranges.collect() for k in range(r["first"], r["last"] + 1)}

    from corpusloom.llm.anchors import named

    upto = 0
    for size in (9, 3, 20, 1, 2, len(rows)):
        batch, upto = rows[upto : upto + size], upto + size
        if not batch:
            continue
        found = family.add(frame(spark, batch))
        new = {r["doc_id"] for r in found.filter("fresh").collect()}
        assert new <= {i for i, _ in batch}
        got.update(windows(found))
        assert set(got) == windows(repeated_ranges(named(frame(spark, rows[:upto])), 60))
        sizes = [n for _, n in family.levels()]
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:], strict=False))
    before = family.levels()
    assert family.add(empty(spark)).count() == 0 and sum(n for _, n in family.levels()) == sum(n for _, n in before)


def test_pieces(spark):
    """Texts longer than a piece, whose windows are found piece by piece, with the anchors of the whole text."""
    from corpusloom.llm.anchors import find_segments

    rng = random.Random(5)
    ws = [f"w{rng.randrange(50)}" for _ in range(5000)]
    docs = spark.createDataFrame([(1, " ".join(ws)), (2, " ".join(ws[1000:3000]))], "doc_id long, text string").coalesce(1)

    def anchors(piece):
        return sorted((r["doc_id"], r["s"] + k, r["a"]) for r in find_segments(docs, True, 50, 10, False, piece).collect() for k in range(r["n"]))

    whole = anchors(1 << 21)
    assert [w[:2] for w in whole] == [(d, k) for d, n in ((1, 5000), (2, 2000)) for k in range(n - 49)]
    assert anchors(700) == anchors(51) == whole


def test_bpe(spark, corpus):
    from tokenizers import Tokenizer

    from corpusloom.llm import bpe
    from corpusloom.llm.registry import tokenizer_path

    lib = Tokenizer.from_file(tokenizer_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [*corpus, (200, "x" * 3000), (201, "aaaa" * 500 + "!?" * 300), (202, "İstanbul 12345 naïve 你好 🙂 don't we'll \x1c a")]
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    want.sort(key=lambda r: (r[0] is None, r))
    assert by_id(bpe.encode_digests(frame(spark, rows), tokenizer_path()), "n_tokens", "ids_sha256", "decoded_sha256") == want
    words = sorted({bytes(random.Random(k).choices(b"abc", k=1 + k % 5)) for k in range(200)})
    auto = bpe.Automaton(bpe.compile_words(words))
    assert [auto.find(w) for w in words] == list(range(len(words))) and auto.find(b"abcabcabc") == -1
    assert bpe.encode_digests(empty(spark), tokenizer_path()).count() == 0
    got = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark, rows), tokenizer_path()).collect() if r["doc_id"] is not None}
    assert all(got[i]["ids"] == (ids := lib.encode(t or "", add_special_tokens=False).ids) and got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False) for i, t in rows if i is not None)
    counts = Counter(w for _, t in corpus for w in (t or "").lower().split())
    frequent = bpe.frequent_chunks(frame(spark, corpus), most=40)
    least = min(counts[w] for w in frequent)
    assert 0 < len(frequent) <= 40 and all(w in frequent for w, n in counts.items() if n > least * 1.2)
    lexicon = ["don't!!", "Ünï", "x<|endoftext|>y", "hello", "zzzzqqq-1"]
    loaded = bpe.Bpe.unpacked(bpe.Bpe.load(tokenizer_path(), lexicon).packed())
    assert loaded.words.find("don't!!".encode()) >= 0 and loaded.words.find("ünï".encode()) >= 0
    for t in ("don't!! Ünï hello zzzzqqq-1 x<|endoftext|>y", "zzzzqqq-1zzzzqqq-1"):
        assert loaded.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_bpe_holds_chunk_numbers_not_chunks():
    import tracemalloc

    from corpusloom.llm import bpe
    from corpusloom.llm.registry import tokenizer_path

    loaded = bpe.Bpe.load(tokenizer_path())
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(100)] + ["", "\x1c", "é1", "<|endoftext|>"]
    texts = [" ".join(rng.choices(words, k=1000)) for _ in range(400)]
    want = [loaded.encode(t) for t in texts[:20]]
    assert list(loaded.rendered([t.encode() for t in texts[:20]])) == [(len(x), " ".join(map(str, x)), loaded.decode(x)) for x in want]
    raw = [t.encode() for t in texts]
    tracemalloc.start()
    try:
        assert sum(n for n, _, _ in loaded.rendered(raw)) > 400_000
        assert tracemalloc.get_traced_memory()[1] < 12e6  # a string for each of the 400,000 chunks would take over twice that
    finally:
        tracemalloc.stop()


def test_workers_give_back_what_another_operator_kept():
    import weakref

    from corpusloom.llm import common, quality

    class Lexicon:
        pass

    lexicon = Lexicon()
    gone = weakref.ref(lexicon)
    common.kept("bpe")["name"] = lexicon
    del lexicon
    assert common.kept("bpe")["name"] is gone()

    class Docs:  # runs the stage's function in this process
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, schema):
            return list(run(iter(())))

    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "spread", lambda docs: docs)
        quality.keep_quality(Docs(), None)
    assert gone() is None and common.kept() == {}


def test_warc(spark, tmp_path):
    from corpusloom.llm import warc

    rng = random.Random(2)
    big = "".join(rng.choice("abc\r\nWARC/1.1 é") for _ in range(200_000))
    pages = [(1, "http://a/1", "x" * 1500), (2, "http://a/2", "x" * 1500), (3, "http://a/3", "x" * 999), (4, "http://a/4", "x" * 999), (5, None, None), (6, "http://b/\r\n", big), (7, "u", "x" * 1500), (None, "n", "x" * 1500), (8, "http://c", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as refers", "2 as payload_bytes").repartition(3)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.warc_round_trip(df).collect()}
    digest = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    refers = {1: 7, 2: 7, 6: 8}
    assert got == {i: ("revisit" if i in refers else "response", refers.get(i), len((h or "").encode()), digest(h)) for i, _, h in pages}
    warc.write_archives(df, str(tmp_path / "w"))
    texts = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, str(tmp_path / "w")).filter("record_type = 'response'").collect()}
    assert bytes(texts[8]) == big.encode() and bytes(texts[5]) == b""
    with pytest.raises(warc.ArchiveError):
        warc.reassemble([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(warc.ArchiveError):
        warc.reassemble([(1, None, b"a"), (2, 3, b"b")])
    assert warc.warc_round_trip(df.filter("page_id < 0")).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    """Records of every kind, of either version, whole files or members compressed, standard revisits, segments."""
    import base64
    import gzip

    from corpusloom.llm import warc

    def record(version="1.0", block=b"", **fields):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
        return f"WARC/{version}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"some page\r\n" * 20
    sha = hashlib.sha1(body).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(body)
    pieces = b"HTTP/1.1 200 OK\r\nTransfer-Encoding:  Chunked\r\n\r\n" + warc.chunked(body)
    first = [
        record(block=b"software: x\r\n", WARC_Type="warcinfo", WARC_Record_ID="<i>"),
        record(block=b"GET / HTTP/1.1\r\n\r\n", WARC_Type="request", WARC_Record_ID="<q>"),
        record(block=http + body, WARC_Type="response", WARC_Record_ID="<r1>", WARC_Target_URI="http://x/1"),
        record("1.1", http + body, WARC_Type="response", WARC_Record_ID="<r2>", WARC_Target_URI="http://x/2", WARC_Payload_Digest="sha1:" + base64.b32encode(sha).decode()),
        record(block=pieces, WARC_Type="response", WARC_Record_ID="<r3>", WARC_Payload_Digest="sha1:" + sha.hex()),
        record(block=body, WARC_Type="resource", WARC_Record_ID="<r4>", WARC_Payload_Digest="md5:00", X_Folded="a\r\n  b"),
        record(block=b"", WARC_Type="metadata", WARC_Record_ID="<m>"),
    ]
    second = [
        record(block=http, WARC_Type="revisit", WARC_Record_ID="<v1>", WARC_Target_URI="http://x/3", WARC_Refers_To="<r1>", WARC_Refers_To_Target_URI="http://x/1", WARC_Payload_Digest="sha1:" + base64.b32encode(sha).decode()),
        record(block=b"", WARC_Type="revisit", WARC_Record_ID="<v2>"),
        record(block=pieces[:50], WARC_Type="response", WARC_Record_ID="<s>", WARC_Segment_Number="1"),
        record(block=pieces[50:], WARC_Type="continuation", WARC_Record_ID="<s2>", WARC_Segment_Number="2", WARC_Segment_Origin_ID="<s>", WARC_Segment_Total_Length=str(len(pieces))),
        record(block=http + body[:7], WARC_Type="response", WARC_Record_ID="<t>", WARC_Truncated="length", WARC_Payload_Digest="sha1:" + sha.hex()),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, first)))
    (tmp_path / "b.warc").write_bytes(b"".join(second))
    got = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert {k: r["record_type"] for k, r in got.items()} == {**dict.fromkeys(["<r1>", "<r2>", "<r3>", "<s>", "<t>"], "response"), "<r4>": "resource", "<v1>": "revisit", "<v2>": "revisit"}
    assert all(bytes(got[k]["payload"]) == body and got[k]["payload_digest"] == sha.hex() and got[k]["payload_bytes"] == len(body) for k in ("<r1>", "<r2>", "<r3>", "<r4>", "<s>"))
    assert bytes(got["<t>"]["payload"]) == body[:7] and got["<r1>"]["page_id"] is None and got["<r2>"]["target_uri"] == "http://x/2"
    assert (got["<v1>"]["refers_to_uri"], got["<v1>"]["payload_bytes"], got["<v1>"]["payload_digest"], got["<v1>"]["payload"]) == ("http://x/1", len(body), sha.hex(), None)
    assert got["<v2>"]["payload_bytes"] is None and got["<v2>"]["refers_to"] is None
    for bad in (b"HTTP/1.1 200\r\n", record(block=http + b"other", WARC_Type="response", WARC_Payload_Digest="sha1:" + sha.hex()), record(block=body, WARC_Type="response")[:-9]):
        (tmp_path / "c.warc").write_bytes(bad)
        with pytest.raises(Exception, match="ArchiveError"):
            warc.read_archives(spark, str(tmp_path)).count()


def test_decontaminate(spark):
    from corpusloom.llm import decontaminate as D

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *(0 for _ in b)][:1] + _next(row, x, b, i)
        return row[-1]

    def _next(row, x, b, i):
        out, left = [], i
        for j, y in enumerate(b, 1):
            left = min(row[j] + 1, left + 1, row[j - 1] + (x != y))
            out.append(left)
        return out

    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(6, 40)))) for k in range(30)] + [(90, None), (91, ""), (92, "w1 w2 w3")]
    docs = []
    for n in range(120):
        words = rng.choices(vocab, k=40)
        if n % 2:
            x = items[n % 30][1].split()
            for _ in range(rng.randint(0, len(x) // 4)):
                p = rng.randrange(len(x))
                x[p : p + rng.randint(0, 1)] = rng.choices(vocab, k=rng.randint(0, 1))
            words[20:20] = x
        docs.append((n, " ".join(words)))
    docs += ODD
    want = set()
    for i, t in docs:
        ws = (t or "").split()
        for k, s in items:
            item = (s or "").split()
            if item and any(edits(item, ws[a : a + len(item)]) <= len(item) // 5 for a in range(len(ws) - len(item) + 1)):
                want.add((i, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(frame(spark, docs), bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 30
    assert D.find_leaks(empty(spark), bench).count() == 0 and D.find_leaks(frame(spark, docs), bench.filter("item_id < 0")).count() == 0


def auc(pairs):
    """Chance that a row of label 1 scores above one of label 0."""
    pos, neg = ([s for s, y in pairs if y == v] for v in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_classifiers(spark):
    from zlib import crc32

    from corpusloom.llm import quality, toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    y = {r["doc_id"]: r for r in labels.collect()}
    n = docs.count()
    # a constant has an AUC of 0.5 and, for the rarer class, a recall or specificity of 0
    for rows, column, folds, held, least in ((quality.quality(docs, labels), "quality", 3, 1, (0.98, 0.95, 0.95)), (toxicity.toxicity(docs, labels), "toxic", 5, 0, (0.93, 0.6, 0.97))):
        got = rows.collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % folds == held) for r in got)
        pairs = [(r["score"], y[r["doc_id"]][column]) for r in got if r["held_out"] and r["doc_id"] in y and y[r["doc_id"]][column] is not None]
        hit = lambda v: sum((s >= 0.5) == (v == 1) for s, x in pairs if x == v) / sum(x == v for _, x in pairs)  # noqa: B023, E731
        assert auc(pairs) >= least[0] and hit(1) >= least[1] and hit(0) >= least[2]
    odd = frame(spark, [*ODD, (110, "word " * 300_000), (111, "." * 50_000), (110, "word " * 300_000)])
    none = labels.filter("doc_id < 0")
    model = toxicity.train_toxicity(docs, labels)
    for train in (none, labels):
        for got in (quality.quality(odd, train).collect(), toxicity.toxicity(odd, train).collect()):
            assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
            assert all(r["held_out"] is None for r in got if r["doc_id"] is None)
    for empty_run in (quality.quality(empty(spark), labels), toxicity.toxicity(empty(spark), labels), toxicity.offending_sentences(empty(spark), model), quality.keep_quality(empty(spark), quality.train_quality(docs, none))):
        assert empty_run.count() == 0
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id").select("doc_id", "text")
    found = toxicity.offending_sentences(toxic, model).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in toxic.collect()}
    assert len({r["doc_id"] for r in found}) > 0.5 * len(texts)
    for r in found:
        assert texts[r["doc_id"]][r["start"] : r["stop"]].decode() == r["sentence"] and 0 < r["stop"] - r["start"] and not re.search(r"[.!?\n]", r["sentence"])
    # offending sentences are what sets toxic documents apart: few of clean ones have any
    clean = docs.join(labels.filter("toxic = 0"), "doc_id").select("doc_id", "text")
    assert toxicity.offending_sentences(clean, model).select("doc_id").distinct().count() < 0.05 * clean.count()


def plain_features(words, bits, hash_of):
    """Word, word-pair and repetition features of one bag, with plain integers."""
    odd, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    fold = lambda x: ((x ^ x >> 32) * odd & mask) >> 64 - bits
    h = [hash_of(w) for w in words]
    found = {fold(x) for x in h} | {fold(((a ^ a >> 31) * odd + b) & mask) for a, b in zip(h, h[1:], strict=False)}
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return found | ({1} if same else set()) | ({2} if same * 4 > len(words) else set())


def test_scores_against_plain_code():
    """Batched features and scores against loops over sentences and words, on texts of every kind."""
    from corpusloom.llm import quality, toxicity
    from corpusloom.llm.common import word_spans
    from corpusloom.llm.labelled import MARKS, WORD

    rng = random.Random(2)
    texts = ["", " ", "a", "a a a a. B b!", "...", "no end", "x\n\ny? ", "Ünï ΑΣ 'tis -- -- ok", "word " * 3000] + ["".join(rng.choice("ab. \n!?-é") for _ in range(rng.randint(0, 90))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    seen = {}

    def hash_of(w):
        if w not in seen:
            seen[w] = int(word_spans(w, WORD if WORD[w[0]] else MARKS)[2][0])
        return seen[w]

    token = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
    weights = np.random.default_rng(3).normal(0, 1, 1 << quality.BITS)
    q = quality.QualityModel(weights, 0.3, 1.5, -0.2)
    for t, s in zip(raw, q.scores(raw), strict=True):
        f = plain_features(token.findall(t.lower()), quality.BITS, hash_of)
        assert abs(s - 1 / (1 + np.exp(-(1.5 * (0.3 + (sum(weights[x] for x in f) / len(f) ** 0.5 if f else 0)) - 0.2)))) < 1e-4
    weights = np.random.default_rng(4).normal(0, 0.5, 1 << toxicity.BITS)
    m = toxicity.ToxicityModel(weights, -1.0, 1.2, 0.1)
    want, total = {}, np.zeros(len(raw))
    for k, t in enumerate(raw):
        for x in re.finditer(rb"[^.!?\n]+", t):
            if words := token.findall(x[0].lower()):
                z = -1.0 + sum(weights[f] for f in plain_features(words, toxicity.BITS, hash_of))
                want[k, x.start(), x.end()] = z
                total[k] += np.logaddexp(0, z)
    got = {(int(k), int(a), int(b)): z for text, start, stop, logit in m.sentences(raw) for k, a, b, z in zip(text, start, stop, logit, strict=True)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-4 for x in want)
    assert np.allclose(m.scores(raw), 1 / (1 + np.exp(-(1.2 * np.log(np.expm1(np.clip(total, 1e-9, 30))) + 0.1))), atol=1e-5)


def test_dual_descent_against_plain_descent():
    """The squared hinge loss that dual coordinate descent reaches, against gradient descent on the primal."""
    from corpusloom.llm.quality import descend

    rng = np.random.default_rng(5)
    x = rng.random((40, 12)) < 0.4
    y = (x[:, 0] | x[:, 1] & (rng.random(40) < 0.8)).astype(int)
    rows, ratio = [np.flatnonzero(r) for r in x], rng.normal(0, 1, 12)
    value = x * ratio / np.sqrt(np.maximum(1, x.sum(1)))[:, None]
    sign, cost = np.where(y == 1, 1.0, -1.0), np.where(y == 1, 1.0, (y == 1).sum() / (y == 0).sum())

    def loss(w, b):
        return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - sign * (value @ w + b)) ** 2).sum()

    w, b = np.zeros(12), 0.0
    for _ in range(20_000):
        slack = np.maximum(0, 1 - sign * (value @ w + b)) * cost * sign
        w, b = w - 0.01 * (w - 2 * value.T @ slack), b - 0.01 * (b - 2 * slack.sum())
    scaled, bias = descend(rows, y, ratio)
    assert loss(scaled / ratio, bias) <= loss(w, b) * 1.01


def test_licenses(spark):
    from corpusloom.llm.licenses import license_scan

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(9001, "Some prose.\nReleased under the MIT License."), (9002, "His driver license was renewed in version 3."), *ODD], "doc_id long, text string"))
    got = {(r["doc_id"], r["family"]) for r in license_scan(docs).collect()}
    plain = {"MIT License.": "mit", "Apache License, Version 2.0.": "apache-2.0", "GNU General Public License, version 3.": "gpl-3.0", "CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary"}
    want = {(r["doc_id"], f) for r in docs.collect() for line in (r["text"] or "").split("\n") for k, f in plain.items() if line.endswith(k)}
    assert got == want and (9001, "mit") in got
    assert license_scan(empty(spark)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as start", "'x' as family", "2 as paragraph")
    assert {(r["doc_id"], r["family"]) for r in license_scan(clash).collect()} == got


#: Standard notices as they stand in files, wrapped.
WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "gpl-2.0": "you can redistribute it and/or modify it under the terms of the GNU\nGeneral Public License as published by the Free Software Foundation;\neither version 2 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.",
}


def test_wrapped_licenses():
    from corpusloom.llm import licenses as L

    prose = ["The river rose twice that year and the town moved uphill", "He renewed his licence in version 3 of the form, which the council granted free of charge.", "All seats are reserved for members of the public", "A copy of the notice was published in every paper"]
    other = [f"{w} went to the {x} and came back with nothing but {y}" for w in ("Ann", "Bob", "Cid") for x in ("market", "harbour", "hill") for y in ("salt", "news", "rope")]
    model = L.fit(other)
    for family, notice in WRAPPED.items():
        for mark in ("", "# ", " * ", "// "):
            body = "\n".join(mark + x for x in notice.split("\n"))
            for before in ("", "\n\n", prose[0] + "\n", prose[0] + "\n\n"):
                text = (before + body + "\n\n" + prose[1] + "\n").encode()
                found = model.scan([b"", text, b"\n"])
                assert {x[4] for x in found} == {family} and {x[0] for x in found} == {1}, (family, before, found)
                assert all(0.5 <= x[5] <= 1 and x[6] >= 0.6 for x in found)
                start, stop = min(x[2] for x in found), max(x[3] for x in found)
                assert text[start:stop].decode().strip().startswith(body.split("\n")[0].strip() if before != prose[0] + "\n" else "") and stop <= len((before + body).encode())
                assert [x[1] for x in found] == sorted(text[: x[2]].count(b"\n") for x in found)
    assert model.scan(["\n".join(prose * 30).encode(), "\n\n".join(prose).encode()]) == []
    long = "\n".join([prose[0]] * 50 + WRAPPED["isc"].split("\n") + [prose[0]] * 50)  # in a run of more than RUN lines
    assert {x[4] for x in model.scan([long.encode()])} <= {"isc"}
    assert model.scan([("word " * 300_000).encode()]) == []


def test_license_probabilities_against_plain_code():
    from corpusloom.llm import licenses as L

    model = L.fit([])
    paragraphs = [t for texts in L.TEMPLATES.values() for t in texts] + L.NEAR_MISSES
    features = L.features(paragraphs)
    of = np.repeat(np.arange(len(features)), [len(x) for x in features])
    bags, z = model.logits(of, np.concatenate(features))
    for k, x in enumerate(features):
        plain = (sum(model.weights[f] for f in x) / len(x) ** 0.5 + model.bias) / model.temperature
        assert bags[k] == k and np.allclose(z[k], plain, atol=1e-4)
    own = [n for n, (texts) in enumerate(L.TEMPLATES.values(), 1) for _ in texts]
    assert all(model.similarity(features[k], n) > 0.999 for k, n in enumerate(own))


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in P.STAGES[:-1]:
        kept = P.cut(stage(spark, out, SF))
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(out).count() == 0, name
        out = kept
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in out.collect()]
    assert len(set(texts)) == len(texts) > 0
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in t for i in items for t in texts)
    assert P.STAGES[-1][1](spark, out, SF).count() == out.count()
    duckdb.connect().close()


def best_edits(item, ws):
    """Least edit distance of the item to a window of ws of any length."""
    row = [0] * (len(ws) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(ws, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage, and run(), against plain code on a small table with copies, leaks, null and repeated rows."""
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from corpusloom.llm import quality
    from corpusloom.llm.registry import tokenizer_path

    rng = random.Random(21)
    source, bench, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark", "labels"))
    items = [(r["item_id"], r["text"]) for r in bench.orderBy("item_id").limit(12).collect()]
    rows = [tuple(r) for r in source.filter("length(text) < 3000").orderBy("doc_id").limit(110).collect()]
    texts = [r[1] for r in rows if len(r[1].split()) > 60]
    new = iter(range(5000, 6000))
    for t in texts[:12]:
        ws = t.split()
        near, far = list(ws), list(ws)
        near[len(ws) // 2] = "changed"
        for k in rng.sample(range(len(ws)), len(ws) // 5):
            far[k] = f"other{k}"
        for copy in (t, "  ".join(ws), " ".join(near), " ".join(far)):
            rows.append((next(new), copy, "en", "copies", len(copy)))
    for _, leak in items[:6]:
        ws = leak.split()
        ws[len(ws) // 2] = "edited"
        text = " ".join([*texts[20].split()[:40], *ws, *texts[21].split()[:40]])
        rows.append((next(new), text, "en", "leaks", len(text)))
    rows += [(None, texts[30] + " more", None, None, None), (7000, None, "en", "odd", 0), (7001, "", "en", "odd", 0), (7002, " ", "en", "odd", 1), rows[3], rows[3], (rows[4][0], texts[31] + " with another end", "en", "odd", 5)]
    rng.shuffle(rows)
    sf = str(tmp_path)
    spark.createDataFrame(rows, source.schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keyed = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    # quality
    model = quality.train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = Counter((r[0], r[1]) for r in rows if model.scores([(r[1] or "").encode()])[0] >= 0.5)
    kept = P.cut(P.STAGES[0][1](spark, docs, sf))
    assert keyed(kept) == want and 0 < sum(want.values())
    # the other stages get all rows, so that each has work to do
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in rows:
        k = norm(r[1])
        first[k] = r[0] if first.get(k) is None else min(first[k], r[0] if r[0] is not None else first[k])
    want = Counter({(r[0], r[1]) for r in rows if first[norm(r[1])] == r[0]})
    exact = P.cut(P.STAGES[1][1](spark, docs, sf))
    got = keyed(exact)
    assert {(i, norm(t)) for i, t in got} == {(i, norm(t)) for i, t in want} and sum(got.values()) == len({(i, norm(t)) for i, t in want})

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    nodes = sorted({(i, t or "") for i, t in got if i is not None})
    sets, root = [grams(t) for _, t in nodes], list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    gone = {nodes[k] for k in range(len(nodes)) if find(k) != k}
    near = P.cut(P.STAGES[2][1](spark, exact, sf))
    left = {(i, t or "") for i, t in keyed(near)}
    assert {(i, t or "") for i, t in got} - left <= gone and len(gone - left) >= 0.95 * len(gone) > 5

    word = lambda t: re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", (t or "").lower())
    leaking = {(i, t) for i, t in keyed(docs) if any(best_edits(word(s), word(t)) <= len(word(s)) // 5 for _, s in items)}
    clean = keyed(P.cut(P.STAGES[3][1](spark, docs, sf)))
    assert set(clean) == set(keyed(docs)) - leaking and len(leaking) >= 6

    lib = Tokenizer.from_file(tokenizer_path())
    tokens = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in P.STAGES[4][1](spark, docs, sf).collect()}
    assert tokens == {(r[0], len(ids := lib.encode(r[1] or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for r in rows}

    out = docs
    for _, stage in P.STAGES[:-1]:
        out = P.cut(stage(spark, out, sf))
        assert out.columns == docs.columns
    assert sorted(map(str, P.run(spark, sf).collect())) == sorted(map(str, P.STAGES[-1][1](spark, out, sf).collect()))
    for t in ("documents",):
        docs.filter("false").write.parquet(f"{sf}/none/{t}.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{sf}/none/{t}.parquet")
    assert P.run(spark, f"{sf}/none").count() == 0


def test_least_hashed(spark):
    from pyspark.sql import functions as F

    from corpusloom.llm.labelled import least_hashed

    rows = spark.range(5000)
    h = F.xxhash64("id")
    for most in (1, 37, 4999, 9000):
        assert least_hashed(rows, h, "id", most).collect() == rows.orderBy(h, "id").limit(most).collect()
    assert least_hashed(rows.filter("id < 0"), h, "id", 5).count() == 0


def test_near_stage_recall(spark):
    """Against brute force at 0.8, with copies of every similarity, a large group and a chain."""
    import corpus_pipeline as P
    from corpusloom.llm.simhash import near_links

    rng = random.Random(12)
    vocab = [f"v{k}" for k in range(3000)]
    rows = []
    for _ in range(150):
        base = rng.choices(vocab, k=rng.randint(20, 300))
        copy = list(base)
        for _ in range(rng.randint(0, len(base) // 20 + 1)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        rows += [" ".join(base), " ".join(copy).upper()]
    base = rng.choices(vocab, k=200)
    rows += [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(60)]  # more than SMALL share keys
    rows += [" ".join(base[9 * k :] + rng.choices(vocab, k=9 * k)) for k in range(4)] + ["", "one two"]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in rows]
    near = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(near):
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {k for k in range(len(rows)) if find(k) != k}
    docs = frame(spark, list(enumerate(rows))).cache()
    links = {(min(r), max(r)) for r in near_links(docs.selectExpr("doc_id node", "text"), 5, 0.8).collect()}
    kept = {r["doc_id"] for r in P.near_stage(spark, docs, SF).collect()}
    gone = set(range(len(rows))) - kept
    between = {(a, b) for a, b in near if a < 300 and len(sets[a] & sets[b]) < 0.95 * len(sets[a] | sets[b])}
    assert links <= near and len(between) > 40
    joined = list(range(len(rows)))  # the links needn't be all pairs, but must join what they are

    def group(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in links:
        joined[max(group(a), group(b))] = min(group(a), group(b))
    assert sum(group(a) == group(b) for a, b in between) >= 0.97 * len(between)
    assert gone <= want and len(gone) >= 0.98 * len(want)


def test_decontaminate_net_edits(spark):
    """Insertions and deletions up to the budget, against brute force over all window lengths."""
    from corpusloom.llm import decontaminate as D

    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]

    def least(item, ws):
        row = [0] * (len(ws) + 1)  # a window may begin anywhere
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(ws, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)  # and end anywhere

    items = [(k, rng.choices(vocab, k=length)) for k, length in enumerate([5, 15, 20, 30, 40] * 8)]
    docs = []
    for n in range(240):
        k, item = items[n % len(items)]
        copy, budget = list(item), len(item) // 5
        for _ in range(budget if n % 4 else budget + 1):
            p = rng.randrange(1, len(copy) - 1)
            copy[p : p + n % 3 // 2 + (n % 3 == 0)] = [] if n % 3 == 0 else [rng.choice(vocab)]
        docs.append((n, " ".join(rng.choices(vocab, k=n % 5 * 4) + copy + rng.choices(vocab, k=n % 7 * 3))))
    want = {(n, k): d for n, t in docs for k, item in items if (d := least(item, t.split())) <= len(item) // 5}
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items], "item_id long, text string")
    rows = D.find_leaks(frame(spark, docs), bench, free_ends=True).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in rows}
    assert len(want) > 150 and got.items() <= want.items() and len(got) >= 0.99 * len(want)
    for r in rows:
        rest = dict(docs)[r["doc_id"]].split()[r["first_word"] :]
        item = items[r["item_id"]][1]
        assert min(least(item, rest[:m]) for m in range(1, len(rest) + 1)) == r["edits"]


def test_bucket_recall():
    """The CGK tables alone: passages at the edge of the budget find their item in a bucket, unrelated stretches seldom find any."""
    from corpusloom.llm import decontaminate as D
    from corpusloom.llm.common import word_spans

    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(600)]
    items = [(k, rng.choices(vocab, k=length)) for k, length in enumerate([10, 15, 20, 30, 45, 59] * 10)]
    block = D.Items([(k, " ".join(ws)) for k, ws in items])
    found, far, n = 0, 0, 0
    for k, item in items:
        for _ in range(5):
            copy, budget = list(item), len(item) // 5
            for _ in range(budget):
                p, kind = rng.randrange(1, len(copy) - 1), rng.randrange(3)
                copy[p : p + (kind != 1)] = [] if kind == 0 else [rng.choice(vocab)]
            for ws, own in ((rng.choices(vocab, k=budget) + copy + rng.choices(vocab, k=budget), True), (rng.choices(vocab, k=len(item) + 2 * budget), False)):
                h = word_spans(" ".join(ws).encode(), D.INSIDE)[2]
                got = {x for _, x in block.candidates(h, np.array([[0, len(h)]]), len(item))}
                found += own and k in got
                far += not own and bool(got)
            n += 1
    assert found >= 0.99 * n and far <= 0.1 * n


def test_pipeline_repeated_ids(spark):
    """Only the decided rows of an id go, and a repeated row stays once."""
    import corpus_pipeline as P

    rng = random.Random(3)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(500)}" for _ in range(60)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (7, c), (8, c + " end"), (8, d)]
    exact = sorted((r["doc_id"], r["text"]) for r in P.exact_stage(spark, frame(spark, rows), SF).collect())
    assert exact == sorted([(3, a), (5, b), (7, c), (8, c + " end"), (8, d)])
    assert sorted((r["doc_id"], r["text"]) for r in P.near_stage(spark, frame(spark, exact), SF).collect()) == sorted([(3, a), (5, b), (7, c), (8, d)])
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    left = P.benchmark_stage(spark, frame(spark, [(5, leak), (5, b)]), SF).collect()
    assert [(r["doc_id"], r["text"]) for r in left] == [(5, b)]
