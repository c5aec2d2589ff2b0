"""SimHash near-dedup by a binary-trie self-join.

A document's fingerprint has a bit for each majority among the hashes of its word
shingles. Fingerprints form a binary trie. The self-join walks pairs of trie nodes from
the root, adds one to a pair's error where the two branches differ, and drops the pair
when the error exceeds the budget.

The top of the walk is a table of node pairs with the number of fingerprints below them,
expanded a few bits a round until a pair holds at most 2 * CELL fingerprints, whatever the
size of the corpus; crowded pairs just go deeper. A node's task gets its own fingerprints and
those of the nodes that it is paired with (at depth d some 1 + (d + d^2 / 2) / 2 of them, so
some hundred thousand numbers at 10^11 documents) and walks the rest of the trie over arrays,
at most FRONTIER node pairs at a time. Only counts come to the driver.

Two uses:

* ``simhash_groups``: 64-bit fingerprints of XXH64 linked at 2 or fewer bits. A task returns
  a spanning forest of its links; the forests' components are joined by distributed star
  rounds. Equal fingerprints meet in one row beforehand, so copies cost nothing.
* ``near_groups``: texts with a Jaccard similarity of 0.8 or more of their shingle sets. At
  0.8 some 15 % of the bits of two fingerprints differ, too many for a small budget over 64
  bits, so each text gets TABLES independent fingerprints of BITS bits, each in a trie of its
  own, joined at 2 bits (an expected recall of 0.98 at 0.8 and more above). A task returns all
  links of fingerprints that have at most 16 and a spanning forest of the others, so that a group
  of near copies, whose fingerprints differ from table to table, gives some links a text in each
  table and not all pairs. A candidate stays if
  at most FAR of all bits differ and is then checked exactly, on whole shingle sets: first
  each text with the root of its tree of candidates, then the candidates that don't both agree
  with one root.

Defined cases: words are runs of bytes other than ASCII white space, A-Z lowered; null texts
count as empty; a text of fewer words than the width is one shingle; texts without words
have fingerprint zero, linked like any other. simhash_groups: null ids keep their row and
never name a component unless it has no other id. near_groups: rows with a null id are never
linked; rows with the same id and text are one. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, join_known, map_text, release, spread, word_spans

SEED = 42
CELL = 1 << 11
FRONTIER = 1 << 20
TABLES, BITS, FAR = 32, 32, 0.22
INSIDE = np.array([bytes([b]).strip() != b"" for b in range(256)])
MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(23).integers(1, 1 << 63, TABLES * BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes, width: int) -> list[bytes]:
    words = raw.lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone cuts
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def majority(h: np.ndarray) -> bytes:
    """Bits set in over half the rows of a matrix of 64-bit numbers, lowest bit first."""
    total = np.zeros(64 * h.shape[1], np.int64)
    for lo in range(0, len(h), 255 << 4):
        bits = np.unpackbits(np.ascontiguousarray(h[lo : lo + (255 << 4)]).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # 255 rows can't overflow a byte
            total += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").tobytes()


def simhash(raw: bytes, width: int = 3) -> int:
    """The fingerprint as an unsigned integer."""
    parts = shingles(raw, width)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x, SEED) for x in parts), np.uint64, len(parts))
    return int.from_bytes(majority(h[:, None]), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def fn(ids, texts):
        return {"doc_id": ids, "fp": np.array([simhash(t, width) for t in texts], np.uint64).view(np.int64)}

    return map_text(spread(docs), id_col, text_col, fn, "doc_id long, fp long")


# the trie


class Trie:
    """Nodes and children (-1: none) of the trie of sorted distinct numbers, level by level."""

    def __init__(self, x: np.ndarray, bits: int):
        self.x, self.child = x, []
        above = np.zeros(min(1, len(x)), np.uint64)
        for depth in range(1, bits + 1):
            nodes = np.unique(x >> np.uint64(bits - depth))
            child = np.full((2, len(above)), -1, np.int32)
            child[(nodes & np.uint64(1)).astype(np.int64), np.searchsorted(above, nodes >> np.uint64(1))] = np.arange(len(nodes), dtype=np.int32)
            self.child.append(child)
            if len(nodes) == len(x):  # every node is one number from here on
                break
            above = nodes

    def down(self, depth: int, side: int, node: np.ndarray) -> np.ndarray:
        return self.child[depth][side][node]


def walk(a: np.ndarray, b: np.ndarray | None, budget: int, bits: int = 64, frontier: int = FRONTIER) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted distinct a and b (None: of a with itself, each pair once) within the budget of differing bits."""
    same, one = b is None, Trie(a, bits)
    b, other = (a, one) if same else (b, Trie(b, bits))
    last = max(len(one.child), len(other.child))
    for t in (one, other):  # the shallower trie goes on to the same depth
        for depth in range(len(t.child), last):
            bit = (t.x >> np.uint64(bits - 1 - depth)) & np.uint64(1)
            child = np.full((2, len(t.x)), -1, np.int32)
            child[bit.astype(np.int64), np.arange(len(t.x))] = np.arange(len(t.x), dtype=np.int32)
            t.child.append(child)
    start = np.zeros(min(1, len(a), len(b)), np.int32)
    stack, out = [(0, start, start, start.astype(np.uint8))], []
    while stack:
        depth, i, j, err = stack.pop()
        if len(i) > frontier:
            stack += [(depth, i[k::2], j[k::2], err[k::2]) for k in (0, 1)]
            continue
        if depth == last:
            keep = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                keep &= i != j
            out.append((i[keep], j[keep]))
            continue
        parts = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            p, q, e = one.down(depth, x, i), other.down(depth, y, j), err + np.uint8(x != y)
            keep = (p >= 0) & (q >= 0) & (e <= budget)
            if same and (x, y) == (1, 0):
                keep &= i != j
            parts.append((p[keep], q[keep], e[keep]))
        if any(len(p[0]) for p in parts):
            stack.append((depth + 1, *(np.concatenate(z) for z in zip(*parts, strict=True))))
    i, j = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (start[:0], start[:0])
    return i.astype(np.int64), j.astype(np.int64)


def forest(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links i-j among the numbers x to keep: a spanning forest."""
    parent, out = list(range(len(x))), []

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append(k)
    return np.array(out, np.int64)


def sparse(x: np.ndarray, i: np.ndarray, j: np.ndarray, few: int = 16) -> np.ndarray:
    """A spanning forest, and all links of the numbers that have few."""
    degree = np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x))
    return np.union1d(np.flatnonzero(np.minimum(degree[i], degree[j]) <= few), forest(x, i, j))


def node_pairs(fps: DataFrame, budget: int, bits: int, cell: int) -> list[tuple[int, DataFrame]]:
    """(depth, table of t, p, q): pairs of trie nodes within the budget, each of at most 2 * cell fingerprints (or of two single ones)."""
    live = fps.groupBy("t").agg(F.count("*").alias("n")).select("t", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), "n")
    live, depth, done = cut(live), 0, []
    most = live.agg(F.max("n")).first()[0] or 0
    first = max(0, (most // cell).bit_length() - 1)  # where evenly spread fingerprints are few enough
    while True:
        done.append((depth, live.filter(F.col("n") <= 2 * cell).select("t", "p", "q")))
        live = live.filter(F.col("n") > 2 * cell).select("t", "p", "q")
        if depth == bits or live.isEmpty():
            return done
        step = min(4, first - depth) if depth < first else 1
        depth += step
        nodes = cut(fps.groupBy("t", F.shiftrightunsigned("fp", bits - depth).alias("node")).agg(F.count("*").alias("n")))
        below = lambda side: nodes.select("t", F.shiftrightunsigned("node", step).alias(side), F.col("node").alias(f"{side}_node"), F.col("n").alias(f"{side}_n"))  # noqa: B023, E731
        pairs = live.join(below("p"), ["t", "p"]).join(below("q"), ["t", "q"]).filter("p_node <= q_node").filter(F.bit_count(F.col("p_node").bitwiseXOR(F.col("q_node"))) <= budget)
        live = cut(pairs.select("t", F.col("p_node").alias("p"), F.col("q_node").alias("q"), F.expr("p_n + if(p_node = q_node, 0, q_n)").alias("n")))


def links(fps: DataFrame, budget: int, bits: int = 64, cell: int = CELL, keep=forest) -> DataFrame:
    """t, u, v, u_node, v_node: links between distinct fingerprints of the same t within the budget, those that `keep` picks in each task.

    fps: t, fp and, if wanted, node (what stands for the fingerprint).
    """
    if "node" not in fps.columns:
        fps = fps.withColumn("node", F.lit(0).cast("long"))

    def dealt(depth: int, pairs: DataFrame) -> DataFrame:
        """Each fingerprint once to its own node, if that is the second of a pair, and once to each node that its own is the first of."""
        rows = fps.select("t", "fp", "node", (F.shiftrightunsigned("fp", bits - depth) if depth else F.lit(0).cast("long")).alias("place"))
        homes = pairs.groupBy("t", "q").agg(F.when(F.bool_or(F.col("p") == F.col("q")), 2).otherwise(1).alias("side"))
        own = rows.join(homes.withColumn("place", F.col("q")), ["t", "place"]).select("t", "q", "side", "fp", "node")
        near = rows.join(pairs.filter("p <> q").withColumnRenamed("p", "place"), ["t", "place"]).select("t", "q", F.lit(0).alias("side"), "fp", "node")
        return own.unionByName(near).withColumn("depth", F.lit(depth))

    def join(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        side, x = t.column("side").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((x, side == 0))  # own ones first
        own, x, node = int((side > 0).sum()), x[order], t.column("node").to_numpy()[order]
        a, b = x[:own], x[own:]
        i, j = walk(a, b, budget, bits) if len(b) else (np.zeros(0, np.int64),) * 2
        j = j + own
        if side.max() == 2:
            p, q = walk(a, None, budget, bits)
            i, j = np.concatenate([i, p]), np.concatenate([j, q])
        kept = keep(x, i, j)
        i, j = i[kept], j[kept]
        release()
        return pa.table({"t": pa.array([key[0].as_py()] * len(kept), pa.int32()), "u": x[i].view(np.int64), "v": x[j].view(np.int64), "u_node": node[i], "v_node": node[j]})

    shape = "t int, u long, v long, u_node long, v_node long"
    found = [dealt(*x).groupBy("t", "depth", "q").applyInArrow(join, shape) for x in node_pairs(fps, budget, bits, cell) if not x[1].isEmpty()]
    return reduce(DataFrame.unionByName, found) if found else fps.selectExpr("t", "fp as u", "fp as v", "node as u_node", "node as v_node").filter("false")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id reachable over links)."""
    marked = cut(fingerprints(docs, id_col, text_col, width))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    roots = components(links(fps.select(F.lit(0).alias("t"), "fp"), budget, cell=cell).select("u", "v"))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(ids, "root").select("fp", "size", "component_id")
    return join_known(marked, known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# similarity of shingle sets


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    h = word_spans(raw.lower(), INSIDE)[2]
    width = min(width, len(h))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * MIX + h[k : k + n]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(27)))


def signature(x: np.ndarray) -> bytes:
    """TABLES fingerprints of BITS bits of a shingle set, one after another."""
    if not len(x):
        return bytes(TABLES * BITS // 8)
    h = (x[:, None] ^ (x[:, None] >> np.uint64(29))) * _ODD
    h = (h ^ (h >> np.uint64(32))) * MIX
    return majority(h ^ (h >> np.uint64(29)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """u, v of the pairs whose shingle sets are similar enough. texts: node, text."""

    def fn(batches):
        for b in batches:
            u, v, p, q = b.columns
            keep, last, old = [], None, None
            for x, s, t in zip(u.to_pylist(), p.cast(pa.binary()), q.cast(pa.binary()), strict=True):
                if x != last:
                    last, old = x, shingle_set(s.as_py() or b"", width)
                keep.append(similarity(old, shingle_set(t.as_py() or b"", width)) >= least)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("q")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("p")), "u")
    return both.select("u", "v", "p", "q").mapInArrow(fn, "u long, v long")


def signatures(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """node, sig of docs(node, text); and a row (t, fp, node) for each table."""

    def fn(ids, texts):
        return {"node": ids, "sig": [signature(shingle_set(t, width)) for t in texts]}

    marked = cut(map_text(spread(docs), "node", "text", fn, "node long, sig binary"))
    size = BITS // 8
    pieces = F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: F.conv(F.hex(F.reverse(F.substr(F.col("sig"), t * size + 1, F.lit(size)))), 16, 10).cast("long"))
    return marked, marked.select("node", F.posexplode(pieces).alias("t", "fp"))


def close(pairs: DataFrame, marked: DataFrame, far: float = FAR) -> DataFrame:
    """u, v (u < v, each pair once) of the pairs of nodes whose signatures differ in at most a share `far` of their bits."""

    def fn(batches):
        for b in batches:
            p, q = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in b.columns[2:])
            yield b.select(["u", "v"]).filter(pa.array(np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= far * TABLES * BITS))

    each = pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sides = each.join(marked.select(F.col("node").alias("u"), F.col("sig").alias("p")), "u").join(marked.select(F.col("node").alias("v"), F.col("sig").alias("q")), "v")
    return sides.select("u", "v", "p", "q").mapInArrow(fn, "u long, v long")


def near_links(docs: DataFrame, width: int, least: float, budget: int = 2, cell: int = 1 << 17) -> DataFrame:
    """u, v: verified links of docs(node, text), enough to join what the candidates bring together.

    Of nodes with an equal fingerprint in a table the least stands for the others and is a candidate with
    each of them; it stands for the fingerprint in the trie. Each node is joined to its least candidate,
    the nodes of a tree are compared with its root, and then every candidate pair is checked whose
    nodes don't both agree with one root. So a group of copies gives some links a text, not all pairs.
    """
    marked, rows = signatures(docs, width)
    key = ["t", "fp"]
    fps = cut(rows.groupBy(*key).agg(F.min("node").alias("node"), F.count("*").alias("size")))
    star = rows.withColumnRenamed("node", "v").join(fps.filter("size > 1").select(*key, F.col("node").alias("u")), key).select("u", "v")
    near = links(fps.select(*key, "node"), budget, BITS, cell, sparse).select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    pairs = cut(close(star.unionByName(near), marked))
    discard(fps)
    roots = cut(components(pairs.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("v"))))  # a pair has u < v
    first = cut(verified(roots.filter("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")), docs, width, least))
    agreed = cut(first.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(first.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()))
    of = lambda side: agreed.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    rest = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").filter("not coalesce(u_root = v_root, false)").select("u", "v")
    return first.unionByName(verified(rest, docs, width, least))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), component_id, kept: the rows that are linked to another, one a distinct id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    named = rows.select(F.xxhash64("doc_id", "text").alias("node"), "doc_id", F.xxhash64("text").alias("text_key"), "text")
    roots = cut(components(near_links(named.select("node", "text"), width, least)))
    known = cut(named.select("node", "doc_id", "text_key").join(roots, "node").distinct())
    first = known.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    return known.join(first, "root").select("doc_id", "text_key", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "text_key") == F.col("first")).alias("kept"))
