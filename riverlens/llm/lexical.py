"""Ranked lexical search by a document FP-tree and branch and bound.

Each text is read once and cut down to the terms that the items use: its vector of (term, tf). A task
sorts its documents' vectors by their terms, the most frequent term first, so that vectors share the
paths of a prefix tree; documents with one vector and length are one leaf. Every node of the tree knows
the greatest tf of each term below it and the least m. What these give is a bound on the score of every
document below, and the tree is walked depth first: an item goes on into a subtree only while the bound
there reaches the item's best scores so far. Nothing else is left out, so the result is exact.

A bounded number of documents is searched first. The scores found there are too low rather than too
high as limits of the whole, so all tasks may start from them, and each gives back only rows that
can still be among the best of an item. Items are worked on in blocks of bounded size, whose terms are what
the tasks receive; statistics go over all documents.

Defined cases: a null or empty text has no terms, ranks nowhere and isn't counted; very long texts are
read whole; rows with one item id are one item with the terms of all of them; repeated documents rank
one after the other; documents without an id come last among equal scores; an item without terms, or
with terms that no document has, gives no row; empty tables give an empty result. Columns other than
id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

#: Terms of all items of a block; an item's own terms stay together.
BLOCK_TERMS = 200_000
#: Documents that are searched first, about.
AHEAD = 65_536
#: Entries (term, tf) of the documents of one tree; a task builds one tree after the other.
TREE_ENTRIES = 1_000_000

#: Letters and digits of ASCII, and all that is not ASCII, make terms; A-Z become a-z.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NOT_TERM = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def items_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, terms array<string>): each item's distinct terms."""
    lower = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = items.select(F.col(id_col).cast("long").alias("item_id"), lower.alias("t"))
    own = own.select("item_id", F.expr(f"filter(split(t, '{_NOT_TERM}'), x -> x <> '')").alias("t"))
    return own.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("terms"))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, t array<int>, f array<int>): a document's number of terms, and those of the
    vocabulary with their occurrences. Rows without a term are left out."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for b in batches:
            ids, n, t, f = [], [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(x.as_buffer().to_pybytes()) if x.is_valid else []
                if words:
                    found = np.fromiter((known[w] for w in words if w in known), np.int32)
                    a, c = np.unique(found, return_counts=True)
                    ids.append(i)
                    n.append(len(words))
                    t.append(a)
                    f.append(c.astype(np.int32))
            cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(t, pa.list_(pa.int32())), pa.array(f, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "t", "f"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("x"))
    return d.mapInArrow(run, "doc_id long, n long, t array<int>, f array<int>")


class Node:
    """A node of the tree, or a leaf: terms below it with their greatest tf, the least m, and either
    children or the ids of the documents that have this vector and m."""

    __slots__ = ("terms", "tf", "m", "children", "ids", "depth")

    def __init__(self, terms=None, tf=None, m=0, ids=None, depth=0):
        self.terms, self.tf, self.m, self.ids, self.depth, self.children = terms, tf, m, ids, depth, []


def build(docs: list[tuple], size: int) -> Node:
    """The tree of documents (id, m, terms, tf); terms are numbers below `size`, the most frequent
    first, in ascending order."""
    leaves: dict[tuple, Node] = {}
    for i, m, terms, tf in docs:
        key = (terms.astype(">u4").tobytes(), tf.tobytes(), m)
        leaf = leaves.get(key)
        if leaf is None:
            leaves[key] = Node(terms, tf, m, [i])
        else:
            leaf.ids.append(i)
    most = np.zeros(size, np.int64)

    def close(node: Node) -> Node:
        for c in node.children:
            most[c.terms] = np.maximum(most[c.terms], c.tf)
        node.terms = np.flatnonzero(most)
        node.tf = most[node.terms]
        most[node.terms] = 0
        node.m = min(c.m for c in node.children)
        return node

    stack, last = [Node()], None
    for key in sorted(leaves):
        leaf = leaves[key]
        if last is not None:
            a, b = last.terms, leaf.terms
            k = min(len(a), len(b))
            apart = np.flatnonzero(a[:k] != b[:k])
            shared = int(apart[0]) if len(apart) else k
            below = last
            while stack[-1].depth > shared:
                node = stack.pop()
                node.children.append(below)
                below = close(node)
            if stack[-1].depth < shared:
                stack.append(Node(depth=shared))
            stack[-1].children.append(below)
        last = leaf
    below = last
    while stack:
        node = stack.pop()
        if below is not None:
            node.children.append(below)
        below = close(node) if node.children else None
    return below


class Best:
    """The k best (score, document) of each item, and the least score that still counts."""

    def __init__(self, items: list[np.ndarray], k: int, least: np.ndarray):
        self.items, self.k, self.least = items, k, least.astype(np.int64).copy()
        self.kept: list[list] = [[] for _ in items]
        self.flat = np.concatenate(items)
        self.first = np.cumsum([0, *map(len, items)])[:-1]

    def bounds(self, gain: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Sums of gain over the terms of each active item (no item is without terms)."""
        if 4 * len(active) > len(self.items):
            return np.add.reduceat(gain[self.flat], self.first)[active]
        return np.array([gain[self.items[i]].sum() for i in active.tolist()], np.int64)

    def offer(self, item: int, score: int, ids: list) -> None:
        """Documents of one score. Of equal scores the lower id is better, no id is the worst."""
        heap = self.kept[item]
        keys = sorted(-i if i is not None else -(2**63) for i in ids)
        for key in heapq.nlargest(self.k, keys):
            if len(heap) < self.k:
                heapq.heappush(heap, (score, key))
            elif (score, key) > heap[0]:
                heapq.heapreplace(heap, (score, key))
            else:
                break
        if len(heap) == self.k:
            self.least[item] = max(self.least[item], heap[0][0])

    def search(self, root: Node, weight: np.ndarray) -> None:
        """Depth-first branch and bound; an item follows a branch while its bound can still count."""
        gain = np.zeros(len(weight), np.int64)
        stack = [(root, np.arange(len(self.items)))]
        while stack:
            node, active = stack.pop()
            terms = node.terms
            gain[terms] = weight[terms] * ((1_000_000_000 * node.tf) // (1000 * node.tf + 20 * node.m))
            bound = self.bounds(gain, active)
            gain[terms] = 0
            open_ = (bound >= self.least[active]) & (bound > 0)
            if node.ids is not None:
                for i, s in zip(active[open_].tolist(), bound[open_].tolist(), strict=True):
                    self.offer(i, s, node.ids)
            elif open_.any():
                active = active[open_]
                stack.extend((c, active) for c in reversed(node.children))


def _searched(vec: DataFrame, n_all: int, l_all: int, rank: np.ndarray, weight: np.ndarray, items: list, k: int, least: np.ndarray) -> DataFrame:
    """(item int, doc_id, score): of each task the rows that can be among the k best of an item."""
    shared = vec.sparkSession.sparkContext.broadcast((rank, weight, items, least))

    def run(batches):
        rank, weight, items, least = shared.value
        best = Best(items, k, least)
        held, entries = [], 0
        for b in batches:
            t, f = b.column(2), b.column(3)
            at, tv, fv = t.offsets.to_numpy(), rank[t.values.to_numpy()], f.values.to_numpy().astype(np.int64)
            for j, (i, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                x, y = tv[at[j] : at[j + 1]], fv[at[j] : at[j + 1]]
                order = np.argsort(x)
                held.append((i, 50 + 50 * n * n_all // l_all, x[order], y[order]))
                entries += len(x) + 8
                if entries > TREE_ENTRIES:
                    best.search(build(held, len(weight)), weight)
                    held, entries = [], 0
        if held:
            best.search(build(held, len(weight)), weight)
        rows = [(i, s, -key if key > -(2**63) else None) for i, heap in enumerate(best.kept) for s, key in heap]
        cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["item", "doc_id", "score"])

    return vec.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """Ranks of a block of (item_id, terms), all with terms."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    items = [np.array([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in terms], np.int64) for _, terms in block]
    vec = cut(vectors(docs, vocabulary, id_col, text_col), "lexical-vectors")
    n_all, l_all = vec.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, c in vec.select(F.explode("t").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[t] = c
    rank = np.empty(len(df), np.int64)
    order = np.argsort(-df, kind="stable")
    rank[order] = np.arange(len(df))
    weight = np.floor(1000 * np.log((2 * n_all + 2) / (2 * df[order] + 1))).astype(np.int64)
    items = [rank[x] for x in items]
    some = vec.where("size(t) > 0")
    part = min(1.0, AHEAD / max(1, n_all)) * (1 << 20)
    ahead = some.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 20)) < F.lit(part))
    least = np.ones(len(items), np.int64)
    go = lambda d, limit: _searched(d, n_all, l_all or 1, rank, weight, items, k, limit)
    for i, s in _ranked(go(ahead, least), "item", k).where(F.col("rank") == k).select("item", "score").collect():
        least[i] = s
    ids = spark.createDataFrame([(j, b[0]) for j, b in enumerate(block)], "item int, item_id long")
    return _ranked(go(some, least), "item", k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, best first, ties by id."""
    spark = docs.sparkSession
    own = cut(items_of(items, item_col, item_text_col).where("size(terms) > 0"), "lexical-items")
    total = own.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        if block:
            ranked = _block(docs, block, k, id_col, text_col)
            out = ranked if blocks == 1 else out.union(cut(ranked, "lexical-block"))
    return out


ORACLE_SQL = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents where text is not null),
s as (select count(*)::bigint as n_all, sum(len(ts))::bigint as l_all from d where len(ts) > 0),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
v as (select r, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*)::bigint as tf from (select r, doc_id, len(ts)::bigint as n, unnest(ts) as term from d) group by r, term),
w as (select term, floor(1000 * ln((2 * any_value(n_all) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from v cross join s where term in (select term from i) group by term),
p as (select item_id, r, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all))))::bigint as score
  from i join v using (term) join w using (term) cross join s group by item_id, r),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from p where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50
"""
