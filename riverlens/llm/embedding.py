"""Embedding near-dedup: a hierarchical navigable small-world graph per shard, every shard queried,
beams widened until recall audits pass, cosines verified in double precision, links joined to
components.

Defined cases: a vector that is null, empty or all zero, or holds a null or non-finite component, and
one with a null label, is linked with nothing; only vectors of one label and one length are compared;
equal vectors are one class, so copies are never paired with each other; repeated rows count as
copies; an id with several vectors is one node that is linked through each of them; a null id makes no
component, and the row is kept; an empty table gives an empty result. Columns other than id, vector and
label are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .components import components

COSINE = 0.93
#: Vectors of a shard, neighbours of a node, first beam, queries audited for each block and shard,
#: recall asked of them, query blocks that a task puts to a shard.
SHARD, NEIGHBOURS, BEAM, AUDITED, RECALL, BLOCKS = 2048, 16, 48, 32, 0.999, 32


class Graph:
    """HNSW over unit vectors; similarity is the dot product."""

    def __init__(self, x: np.ndarray, m: int = NEIGHBOURS, beam: int = BEAM):
        self.x, self.m = x.astype(np.float32), m
        n = len(x)
        u = np.random.default_rng(n).random(n)
        self.level = np.minimum((-np.log(1 - u) / np.log(m)).astype(int), 8)
        self.near: list[dict[int, np.ndarray]] = [{} for _ in range(int(self.level.max(initial=0)) + 1)]
        self.entry, self.seen, self.mark = -1, np.zeros(n, np.int64), 0
        for i in range(n):
            self._insert(i, beam)

    def _beam(self, q: np.ndarray, start: list[int], beam: int, layer: int) -> list[tuple[float, int]]:
        """The best nodes found, best first."""
        near, x, seen = self.near[layer], self.x, self.seen
        self.mark += 1
        seen[start] = self.mark
        best = [(float(s), i) for s, i in zip(x[start] @ q, start, strict=True)]
        heapq.heapify(best)
        todo = [(-s, i) for s, i in best]
        heapq.heapify(todo)
        while todo:
            s, i = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= beam:
                break
            new = near[i]
            new = new[seen[new] != self.mark]
            if not len(new):
                continue
            seen[new] = self.mark
            for t, j in zip((x[new] @ q).tolist(), new.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (t, j))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, j))
                else:
                    continue
                heapq.heappush(todo, (-t, j))
        return sorted(best, reverse=True)

    def _spread(self, found: list[int], sims: np.ndarray, m: int) -> np.ndarray:
        """Of candidates in descending similarity, those nearer to the node than to one chosen before;
        then the nearest others, up to m."""
        if len(found) <= m:
            return np.array(found, np.int64)
        between = self.x[found] @ self.x[found].T
        chosen, rest = [], []
        for k in range(len(found)):
            if len(chosen) < m and not (chosen and between[k, chosen].max() > sims[k]):
                chosen.append(k)
            else:
                rest.append(k)
        return np.array(found, np.int64)[(chosen + rest)[:m]]

    def _down(self, q: np.ndarray, stop: int) -> int:
        at = self.entry
        for layer in range(int(self.level[self.entry]), stop, -1):
            at = self._beam(q, [at], 1, layer)[0][1]
        return at

    def _insert(self, i: int, beam: int) -> None:
        own = int(self.level[i])
        if self.entry < 0:
            for layer in range(own + 1):
                self.near[layer][i] = np.empty(0, np.int64)
            self.entry = i
            return
        q, top = self.x[i], int(self.level[self.entry])
        start = [self._down(q, own)] if top > own else [self.entry]
        for layer in range(min(own, top), -1, -1):
            found = self._beam(q, start, beam, layer)
            start = [j for _, j in found]
            most = self.m * (2 if layer == 0 else 1)
            near = self.near[layer]
            near[i] = self._spread(start, np.array([s for s, _ in found]), self.m)
            for j in near[i].tolist():
                more = np.append(near[j], i)
                if len(more) > most:
                    sims = self.x[more] @ self.x[j]
                    order = np.argsort(-sims, kind="stable")
                    more = self._spread(more[order].tolist(), sims[order], most)
                near[j] = more
        for layer in range(top + 1, own + 1):
            self.near[layer][i] = np.empty(0, np.int64)
        if own > top:
            self.entry = i

    def range_search(self, q: np.ndarray, least: float, beam: int) -> np.ndarray | None:
        """Nodes with a similarity of least or more; None if they fill the beam, so that more may be."""
        found = self._beam(q.astype(np.float32), [self._down(q.astype(np.float32), 0)], beam, 0)
        hits = [i for s, i in found if s >= least - 1e-5]
        return None if len(hits) >= beam < len(self.x) else np.array(hits, np.int64)


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links(queries: np.ndarray, x: np.ndarray, graph: Graph, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of every link found between queries and a shard. The beam is doubled until the
    audited queries' links are all but complete; a query whose links fill its beam is compared with
    the whole shard, block by block."""

    def exact(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(0, len(some), 256):
            k, j = np.nonzero(queries[some[i : i + 256]] @ x.T >= least)
            a.append(some[i + k])
            b.append(j)
        return np.concatenate(a), np.concatenate(b)

    n, beam = len(queries), BEAM
    audited = np.arange(0, n, max(1, n // AUDITED))
    truth = set(zip(*(v.tolist() for v in exact(audited)), strict=True))
    while True:
        a, b, full = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for i in range(n):
            hits = graph.range_search(queries[i], least, beam)
            if hits is None:
                full.append(i)
            elif len(hits):
                hits = hits[x[hits] @ queries[i] >= least]
                a.append(np.full(len(hits), i))
                b.append(hits)
        dense = exact(np.array(full, np.int64))
        a, b = np.concatenate([*a, dense[0]]), np.concatenate([*b, dense[1]])
        found = set(zip(a.tolist(), b.tolist(), strict=True)) & truth if truth else truth
        if len(found) >= RECALL * len(truth):
            return a, b
        if beam >= len(x):
            return exact(np.arange(n))
        beam *= 2


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is joined with, over links a - b."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(old, label):
            return label


def _index(batches):
    """Each shard's vectors as a block of queries, and its graph."""
    for b in batches:
        block, graphs = [], []
        for rows in b.column(3).to_pylist():
            rows.sort(key=lambda r: (r["rep"], r["embedding"]))
            x = unit([r["embedding"] for r in rows])
            ids, copies = (np.array([r[k] for r in rows], np.int64) for k in ("rep", "copies"))
            block.append(pickle.dumps((ids, copies, x), protocol=5))
            graphs.append(pickle.dumps(Graph(x), protocol=5))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(block, pa.binary()), pa.array(graphs, pa.binary())], ["label", "dim", "shard", "block", "graph"])


def _found(same: bool, one: tuple, other: tuple, graph: Graph, least: float) -> pa.RecordBatch:
    """Of a block of queries and a shard: (a, a, links) and a spanning forest (a, b, 0)."""
    (ids, copies, x), (ids2, copies2, x2) = one, other
    u, v = _links(x, x2, graph, least)
    count, count2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
    if same:
        low, high = np.minimum(u, v), np.maximum(u, v)
        code = np.unique((low * len(ids) + high)[low != high])
        u, v = code // len(ids), code % len(ids)
        count2 = count
    np.add.at(count, u, copies2[v])
    np.add.at(count2, v, copies[u])
    ends = np.concatenate([ids, [] if same else ids2]).astype(np.int64)
    label = _forest(len(ends), u, v if same else v + len(ids))
    tied = np.flatnonzero(label != np.arange(len(label)))
    total = count if same else np.concatenate([count, count2])
    has = np.flatnonzero(total)
    cols = ((ends[has], ends[tied]), (ends[has], ends[label[tied]]), (total[has], np.zeros(len(tied), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], ["a", "b", "n"])


def _search(least):
    """Over rows sorted by shard and group of blocks: the shard itself (with its graph) comes first,
    then the blocks that are put to it."""

    def run(batches):
        shard = graph = None
        for b in batches:
            for i, j, block, blob in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if blob is not None:
                    shard, graph = pickle.loads(block), pickle.loads(blob)
                else:
                    yield _found(i == j, pickle.loads(block), shard, graph, least)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal vectors of a label become one class with a count, by partial aggregation. The classes of a
    label are dealt to shards of bounded size by a hash of their id. Every shard of a label is asked
    with the vectors of each shard up to itself; a task holds one graph and is sent at most BLOCKS
    blocks of vectors. It sends back counts and a spanning forest, never all pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.col(vector_col).cast("array<double>")
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("embedding"), F.col(label_col).cast("string").alias("label"))
    usable = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and abs(x) < double('Infinity') and not isnan(x)) and exists(embedding, x -> x <> 0)"
    d = d.withColumn("usable", F.coalesce(F.expr(usable), F.lit(False)) & F.col("vec_id").isNotNull())
    d = d.withColumn("h", F.when(F.col("usable"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("usable"), F.xxhash64(F.lit(7), F.reverse("embedding"))))
    classes = d.where("usable").groupBy("label", "h", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("dim", F.size("embedding")), "vectors")

    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.expr("pmod(xxhash64(rep), shards)"))
    spread = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = dealt.repartition(spread, "label", "dim", "shard").groupBy("label", "dim", "shard").agg(F.collect_list(F.struct("rep", "copies", "embedding")).alias("rows"))
    index = cut(packed.mapInArrow(_index, "label string, dim int, shard long, block binary, graph binary"), "graphs")

    of = index.join(sizes, ["label", "dim"])
    key = ["label", "dim", "j", "grp"]
    asks = of.select("label", "dim", F.explode(F.sequence("shard", F.col("shards") - 1)).alias("j"), F.col("shard").alias("i"), "block")
    asks = asks.select(*asks.columns, F.expr(f"i div {BLOCKS}").alias("grp"), F.lit(None).cast("binary").alias("graph"))
    asked = of.select("label", "dim", F.col("shard").alias("j"), F.lit(-1).cast("long").alias("i"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"shard div {BLOCKS}"))).alias("grp"), "graph")
    work = asks.unionByName(asked).repartition(spread, *key).sortWithinPartitions(*key, "i").select("i", "j", "block", "graph")
    found = cut(work.mapInArrow(_search(cosine), "a long, b long, n long"), "links")

    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    parts = components(found.where("n = 0"))
    c = classes.join(counts, classes.rep == counts.a, "left").join(parts, classes.rep == parts.node, "left")
    c = c.select("label", "h", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = d.select("vec_id", "label", "h", "h2").join(c, ["label", "h", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
