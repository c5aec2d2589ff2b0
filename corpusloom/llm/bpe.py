"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's frequent words (chunks between white space, counted over all rows, at most
FREQUENT) and the vocabulary's whole words are compiled with their ids into a minimal acyclic
automaton (Daciuk's incremental construction: common suffixes are shared). Each arc carries
the number of words it skips, so a walk yields a word's number and that its ids. The automaton
and the ids are one flat file in the shared folder, which Spark hands to each executor once and
all its workers memory-map. A word that isn't in it is split by the tokenizer's pattern and
merged exactly, lowest rank first and leftmost among equals.

Text is cut as the tokenizer file says: special tokens literally, then NFC, white space, lower
case, the split pattern. A chunk between white space always encodes alike, so within a
batch of rows each distinct chunk is looked up once.

Normal forms, lower case and classes of characters come from Python's and regex's Unicode
tables, the library's from its own: around characters that are newer than the older of the two
tables (recent combining marks and unassigned code points) results may differ.

Defined cases: null texts count as empty and encode to nothing; null ids keep their
row; words of any length are merged (long ones on a heap, in n log n).
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import os
import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, kept, map_text, shared_dir, spread

NONE = 1 << 62
FREQUENT = 50_000
KEPT = 1 << 18  # unseen chunks of at most 32 characters that a worker keeps: some 150 MB if all are as long as can be
_SEPARATORS = regex.compile("[\x1c-\x1f]")  # Python's split() takes these for white space
#: Unicode white space, a fixed set.
BLANK = regex.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Automaton:
    """A minimal acyclic automaton over byte strings that numbers its words in sorted order."""

    def __init__(self, raw, at: int = 0):
        """raw: a buffer (bytes or a memory map) that holds the automaton from `at` on, a multiple of four."""
        self.raw = raw
        states, arcs, self.root = (int.from_bytes(raw[at + k : at + k + 4], "little") for k in (0, 4, 8))
        view, at = memoryview(raw), at + 12
        self.first, at = view[at : at + 4 * (states + 1)].cast("I"), at + 4 * (states + 1)
        self.target, at = view[at : at + 4 * arcs].cast("I"), at + 4 * arcs
        self.skip, at = view[at : at + 4 * arcs].cast("I"), at + 4 * arcs
        self.final, at = view[at : at + states], at + states
        self.labels = at

    def find(self, word: bytes) -> int:
        """The word's number, or -1."""
        state, n, first, base = self.root, 0, self.first, self.labels
        for c in word:
            k = self.raw.find(_BYTE[c], base + first[state], base + first[state + 1]) - base
            if k < 0:
                return -1
            n += self.skip[k]
            state = self.target[k]
        return n if self.final[state] else -1


_BYTE = [bytes([b]) for b in range(256)]


class Numbers(dict):
    """Distinct things, numbered in the order in which they are asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def compile_words(words: list[bytes]) -> bytes:
    """Flat bytes of the minimal automaton of sorted distinct words."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # parent, label, child: not yet minimal

    def settle(keep: int) -> None:
        while len(path) > keep:
            parent, label, child = path.pop()
            key = (final[child], tuple(arcs[child].items()))
            arcs[parent][label] = known.setdefault(key, child)

    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same)
        at = path[-1][2] if path else 0
        for label in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[at][label] = len(arcs) - 1
            path.append((at, label, len(arcs) - 1))
            at = len(arcs) - 1
        final[at] = True
        last = word
    settle(0)
    order, number, stack = [], {}, [0]
    while stack:  # children first
        s = stack[-1]
        todo = [t for t in arcs[s].values() if t not in number]
        if todo:
            stack += todo
            continue
        stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
    count = [0] * len(order)
    first, target, skip, labels = [0], [], [], bytearray()
    for s in order:
        n = int(final[s])
        for label, t in sorted(arcs[s].items()):
            labels.append(label)
            target.append(number[t])
            skip.append(n)
            n += count[number[t]]
        count[number[s]] = n
        first.append(len(labels))
    head = np.array([len(order), len(labels), number[0]], "<u4").tobytes()
    return head + b"".join(np.array(x, "<u4").tobytes() for x in (first, target, skip)) + bytes(final[s] for s in order) + bytes(labels)


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge neighbours, lowest rank first and leftmost among equals. pairs: left << 16 | right to rank << 16 | merged."""
    if len(ids) > 200:
        return merge_long(ids, pairs)
    get = pairs.get
    found = [get(a << 16 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
    while found and (best := min(found)) != NONE:
        k = found.index(best)
        ids[k] = new = best & 0xFFFF
        del ids[k + 1], found[k]
        if k:
            found[k - 1] = get(ids[k - 1] << 16 | new, NONE)
        if k < len(found):
            found[k] = get(new << 16 | ids[k + 1], NONE)
    return ids


def merge_long(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The same on a heap over a linked list."""
    ids, n = list(ids), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(k):
        if k >= 0 and after[k] < n and (v := pairs.get(key := ids[k] << 16 | ids[after[k]])) is not None:
            heapq.heappush(heap, (v, k, key))

    for k in range(n - 1):
        offer(k)
    while heap:
        v, k, key = heapq.heappop(heap)
        if ids[k] < 0 or after[k] >= n or ids[k] << 16 | ids[after[k]] != key:
            continue
        gone = after[k]
        ids[k], ids[gone], after[k] = v & 0xFFFF, -1, after[gone]
        if after[k] < n:
            before[after[k]] = k
        offer(before[k])
        offer(k)
    return [x for x in ids if x >= 0]


def merge_all(ids: np.ndarray, size: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
    """merge() of many words at once, in place: a row a word, its ids padded on the right; size: how many each has. keys (in order), values: as pairs in merge()."""

    def found(a, b):
        key = a << 16 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], NONE)

    wide = ids.shape[1]
    col = np.arange(wide)
    rank = np.full(ids.shape, NONE, np.int64)  # of each id with the one after it
    rank[:, :-1] = np.where(col[1:] < size[:, None], found(ids[:, :-1], ids[:, 1:]), NONE)
    live = np.arange(len(ids))
    while len(live):
        r = rank[live]
        best = r.argmin(1)  # the first among equals
        v = r[np.arange(len(live)), best]
        go = v < NONE
        live, best, v, r = live[go], best[go], v[go], r[go]
        row = np.arange(len(live))
        x = np.take_along_axis(ids[live], np.minimum(col + (col > best[:, None]), wide - 1), 1)
        r = np.take_along_axis(r, np.minimum(col + (col >= best[:, None]), wide - 1), 1)
        x[row, best] = v & 0xFFFF
        size[live] -= 1
        k = np.flatnonzero(best > 0)
        r[k, best[k] - 1] = found(x[k, best[k] - 1], x[k, best[k]])
        r[row, best] = NONE
        k = np.flatnonzero(best + 1 < size[live])
        r[k, best[k]] = found(x[k, best[k]], x[k, best[k] + 1])
        ids[live], rank[live] = x, r


class Bpe:
    """A tokenizer with its lexicon. Bpe.load makes the parts on the driver, `packed` one byte string of them, which workers map."""

    def __init__(self, data: dict, raw=b"", at: int = 0):
        self.data = data
        self.tokens, self.pattern = data["tokens"], regex.compile(data["pattern"])
        self.pairs = dict(zip(data["left_right"].tolist(), data["rank_merged"].tolist(), strict=True))
        self.plain, self.last = data["plain"], data["last"]
        order = np.argsort(data["left_right"])
        self.keys, self.values = data["left_right"][order], data["rank_merged"][order]
        self.special = {self.tokens[k]: k for k in data["special"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = list(map(str, range(max(self.tokens, default=0) + 1)))
        self.kept: dict[str, tuple[int, str, str]] = {}
        self.words = None
        if raw:
            n, m = (int.from_bytes(raw[at + k : at + k + 4], "little") for k in (0, 4))
            view, at = memoryview(raw), at + 8
            self.ends, at = view[at : at + 4 * n].cast("I"), at + 4 * n
            self.ids, at = view[at : at + 4 * m].cast("I"), at + 4 * m
            self.words = Automaton(raw, at)

    @classmethod
    def load(cls, path: str, lexicon: list[str] | None = None) -> Bpe:
        """From a tokenizer file. lexicon: chunks to compile beside the vocabulary's whole words."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab, letter = model["vocab"], byte_letters()
        tokens = {k: t for t, k in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = cls({
            "tokens": tokens, "special": [t["id"] for t in spec["added_tokens"]],
            "pattern": next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"),
            "left_right": np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.int64),
            "rank_merged": np.array([rank << 16 | vocab[a + b] for rank, (a, b) in enumerate(merges)], np.int64),
            "plain": [vocab[letter[b]] for b in range(256)], "last": [vocab[letter[b] + end] for b in range(256)],
        })
        byte = {c: b for b, c in letter.items()}
        whole = {bytes(byte[c] for c in t[: -len(end)]) for t in vocab if t.endswith(end) and len(t) > len(end) + 1}
        ids = {w: made.merged(w) for w in whole}
        for chunk in lexicon or ():
            for c, special in made.chunks(chunk):  # in the form in which texts give it
                if not special:
                    ids[c.encode()] = made.split(c)
        words = sorted(ids)
        listed = [ids[w] for w in words]
        flat = np.array([x for w in listed for x in w], "<u4")
        ends = np.cumsum([0, *map(len, listed)]).astype("<u4")
        raw = np.array([len(ends), len(flat)], "<u4").tobytes() + ends.tobytes() + flat.tobytes() + compile_words(words)
        return cls(made.data, raw)

    def packed(self) -> bytes:
        """The plain data, pickled, and the lexicon from a multiple of four on."""
        data = pickle.dumps(self.data)
        data += b"\0" * (-len(data) % 4)
        return len(data).to_bytes(4, "little") + data + bytes(self.words.raw)

    @classmethod
    def unpacked(cls, raw) -> Bpe:
        n = int.from_bytes(raw[:4], "little")
        return cls(pickle.loads(raw[4 : 4 + n]), raw, 4 + n)

    def merged(self, word: bytes) -> list[int]:
        plain = self.plain
        return merge([plain[b] for b in word[:-1]] + [self.last[word[-1]]], self.pairs)

    def merged_all(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """merged() of each of the words, of the short ones by the batch."""
        out: dict[bytes, list[int]] = {}
        plain, last = np.array(self.plain, np.int64), np.array(self.last, np.int64)
        low = 0
        for wide in (8, 16, 32):
            some = [w for w in words if low < len(w) <= wide]
            low = wide
            for lo in range(0, len(some), 1 << 13):
                part = some[lo : lo + (1 << 13)]
                raw = np.frombuffer(b"".join([w.ljust(wide, b"\0") for w in part]), np.uint8).reshape(-1, wide)
                size = np.array([len(w) for w in part])
                ids, row = plain[raw], np.arange(len(part))
                ids[row, size - 1] = last[raw[row, size - 1]]
                merge_all(ids, size, self.keys, self.values)
                out.update((w, x[:n]) for w, x, n in zip(part, ids.tolist(), size.tolist(), strict=True))
        out.update((w, self.merged(w)) for w in words if len(w) > low)
        return out

    def known(self, word: bytes) -> list[int] | None:
        k = self.words.find(word) if self.words else -1
        return None if k < 0 else list(self.ids[self.ends[k] : self.ends[k + 1]])

    def word(self, word: bytes) -> list[int]:
        return self.merged(word) if (ids := self.known(word)) is None else ids

    def split(self, chunk: str) -> list[int]:
        """A chunk's ids by the tokenizer's pattern."""
        return [x for w in self.pattern.findall(chunk) for x in self.word(w.encode())]

    def split_all(self, chunks: list[str]) -> list[list[int]]:
        """split() of chunks that aren't in the lexicon; each distinct word is looked up and, if need be, merged once."""
        parts = [[w.encode() for w in self.pattern.findall(c)] for c in chunks]
        whole = {c.encode() for c in chunks}
        ids = {w: None if w in whole else self.known(w) for w in {w for p in parts for w in p}}
        ids.update(self.merged_all([w for w, x in ids.items() if x is None]))
        return [ids[p[0]] if len(p) == 1 else [x for w in p for x in ids[w]] for p in parts]

    def chunk(self, chunk: str) -> list[int]:
        return self.split(chunk) if (ids := self.known(chunk.encode())) is None else ids

    def chunks(self, text: str):
        """Special tokens and the normalised chunks between white space."""
        for part in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if part in self.special:
                yield None, part
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final sigma
            for chunk in BLANK.split(part.lower()) if any("\x1c" <= c <= "\x1f" for c in set(part)) else part.lower().split():
                if chunk:
                    yield chunk, None

    def encode(self, text: str) -> list[int]:
        return [x for c, special in self.chunks(text) for x in ([self.special[special]] if special else self.chunk(c))]

    def decode(self, ids) -> str:
        """Tokens joined by a space, special ones included."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def pieces(self, text: str) -> list[str]:
        """The chunks and special tokens of a text, in order."""
        if self.cut and "<|" in text or not text.isascii():
            return [c or special for c, special in self.chunks(text)]
        low = text.lower()
        return BLANK.split(low) if _SEPARATORS.search(low) else low.split()

    def rendered(self, texts: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, the ids in decimal, and the decoded text, of each text.

        Texts are held as the numbers of their chunks. Each distinct chunk is looked up in the lexicon
        once; those that aren't there are encoded together. Of these the short ones are kept for further
        batches, KEPT at most: what is in the lexicon is always found there.
        """
        collects = gc.isenabled()
        gc.disable()  # millions of short-lived strings, no cycles
        try:
            number = Numbers()
            cut = []
            for raw in texts:
                pieces = self.pieces(raw.decode("utf-8", "replace"))
                cut.append(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)))
            said: list[tuple[int, str, str]] = []
            unseen, kept, special = {}, self.kept, self.special
            for c, k in number.items():
                ids = [special[c]] if c in special else self.known(c.encode()) if c else []
                if ids is None and (x := kept.get(c)) is None:
                    unseen[c] = k
                said.append(self.said(ids) if ids is not None else x)
            del number
            if len(kept) + len(unseen) > KEPT:
                kept.clear()
            for (c, k), ids in zip(unseen.items(), self.split_all(list(unseen)), strict=True):
                said[k] = x = self.said(ids)
                if len(c) <= 32 and len(kept) < KEPT:
                    kept[c] = x
            size = np.array([x[0] for x in said], np.int64)
            ids, tokens = [x[1] for x in said], [x[2] for x in said]
            for t in cut:
                at = t[size[t] > 0].tolist()
                yield int(size[t].sum()), " ".join(map(ids.__getitem__, at)), " ".join(map(tokens.__getitem__, at))
        finally:
            if collects:
                gc.enable()

    def said(self, ids: list[int]) -> tuple[int, str, str]:
        name, token = self.names, self.tokens
        return len(ids), " ".join([name[k] for k in ids]), " ".join([token[k] for k in ids])


def frequent_chunks(docs: DataFrame, text_col: str = "text", most: int = FREQUENT, longest: int = 64) -> list[str]:
    """At most about `most` chunks between white space, in lower case and of at most `longest` characters, that occur most often in all texts.

    Counted with map-side sums; the driver gets the numbers of words by order of magnitude of
    their counts (eight a doubling, so some hundred), and then the words above the bound that follows.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"\s+")).alias("w")).filter("w <> ''").filter(F.length("w") <= longest)
    counts = cut(words.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w", F.floor(F.log2("n") * 8).alias("size")))
    total, bound = 0, None
    for r in sorted(counts.groupBy("size").count().collect(), reverse=True):
        if total + r["count"] > most:
            break
        total, bound = total + r["count"], r["size"]
    found = [] if bound is None else sorted(r[0] for r in counts.filter(F.col("size") >= bound).select("w").collect())
    discard(counts)
    return found


def _worker(name: str) -> Bpe:
    """The tokenizer from the file that Spark gave this executor: mapped once a worker, its pages shared by all."""
    loaded = kept("bpe")
    if name not in loaded:
        loaded.clear()
        with open(SparkFiles.get(name), "rb") as f:
            loaded[name] = Bpe.unpacked(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return loaded[name]


def shipped(spark: SparkSession, bpe: Bpe) -> str:
    """Write the tokenizer to the shared folder and let Spark hand it to the executors; the file's name."""
    raw = bpe.packed()
    name = f"lexicon-{hashlib.sha256(raw).hexdigest()[:32]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(raw))
    out.close()
    if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def _rendered(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, columns, schema: str) -> DataFrame:
    name = shipped(docs.sparkSession, Bpe.load(tokenizer, frequent_chunks(docs, text_col)))
    return map_text(spread(docs), id_col, text_col, lambda ids, texts: {"doc_id": ids, **columns(_worker(name).rendered(texts))}, schema, rows=4096, owner="bpe")


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string. Odd rows: as the module says; an empty table gives no rows."""

    def columns(found) -> dict:
        ids, decoded = [], []
        for _, x, y in found:
            ids.append(np.array(x.split(), np.int32))
            decoded.append(y)
        return {"ids": ids, "decoded": decoded}

    return _rendered(docs, tokenizer, id_col, text_col, columns, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode_documents gives, without moving it."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def columns(found) -> dict:
        rows = [(n, sha(x), sha(y)) for n, x, y in found]
        return {name: [r[k] for r in rows] for k, name in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

    return _rendered(docs, tokenizer, id_col, text_col, columns, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
