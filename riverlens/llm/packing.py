"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens. A window of `window` tokens gives each queue a quantum, its target
share of the window; what a quantum leaves below a whole token is the queue's deficit and goes on to
the next window. A queue's tokens served up to window w are therefore the floor of its cumulative
target, which has a closed form, so every task places its own documents without knowing the others:
no window is worked out on the driver and deficits carry across partitions. When a queue runs dry
the others share its part (a new phase). Windows follow each other without a gap and are cut into
sequences of `length` tokens, so that only the last sequence has room left.

Defined cases: a null or empty text is the end id alone; a very long text is tokenized whole and cut
wherever windows and sequences end; a null source is a queue of its own; repeated rows are documents
of their own; an empty table gives no pieces; a null id stays null. Sources beyond
the `queues` largest that no target names share a queue, which is dealt among them by the same round-robin.
Columns other than id, text and source are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import cut, scratch, ship

LENGTH, END_ID = 4096, 2
#: Tokens over which the targets hold: four sequences.
WINDOW = 4 * LENGTH
#: Queues of one round-robin; the sources of the smallest token counts beyond it are dealt by further ones.
QUEUES = 1000


_TAIL = b".,!?;:%$&*#|"
#: Words that a Python worker keeps the ids of.
KNOWN_WORDS = 1_000_000


def _ends_in_letter(stem: bytes) -> bool:
    """The last character stays one letter in any normal form and in lower case, so that punctuation
    after it begins a token run of its own. Other words go to the tokenizer whole."""
    c = stem.decode()[-1:]
    return c.isalpha() and c < "\u0180" and len(c.lower()) == 1 and c.lower().isalpha()


class Ids:
    """Token ids of whole texts. A tokenizer that never lets a token cross ASCII white space gives
    for a text what it gives for its words one by one, so words are looked up, and only unknown ones
    go to the tokenizers library."""

    def __init__(self, json: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of, self.kind = {}, kind
        self.tokenizer = Tokenizer.from_str(json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        mark = self.tokenizer.encode("~", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.lower = self.tokenizer.encode("Aa", add_special_tokens=False).ids == self.tokenizer.encode("aa", add_special_tokens=False).ids

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [x.encode().split() if x else [] for x in texts]
        out = []
        for i in range(0, len(split), 256):
            part = split[i : i + 256]
            new = set(chain.from_iterable(part)).difference(self.of)
            if len(self.of) + len(new) > KNOWN_WORDS:
                self.of.clear()
                new = set(chain.from_iterable(part))
            self._learn(list(new))
            get = self.of.__getitem__
            out += [b"".join(map(get, words)) for words in part]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """ASCII words are lower-cased by the tokenizer anyway, and punctuation after a letter is a
        token run of its own: a word is its lower-case stem and its tail, which other words share."""
        of, split = self.of, []
        for w in words:
            low = w.lower() if self.lower and w.isascii() else w
            stem = low.rstrip(_TAIL)
            if stem is not low and not _ends_in_letter(stem):
                stem = low
            split.append((w, stem, low[len(stem) :]))
        self._encode([x for x in {x for _, *parts in split for x in parts} if x and x not in of])
        for w, stem, tail in split:
            if w is not stem or tail:
                of[w] = of[stem] + of[tail] if tail else of[stem]

    def _encode(self, words: list[bytes]) -> None:
        """Many words a call, with a mark between them whose one id no other word can have; words
        that hold a part of the mark or of an added token go alone."""
        mark, of = self.mark, self.of
        plain = [w for w in words if mark is not None and b"~" not in w and b"<|" not in w]
        for j in range(0, len(plain), 8192):
            groups = [plain[k : k + 64] for k in range(j, min(j + 8192, len(plain)), 64)]
            found = self.tokenizer.encode_batch_fast([" ~ ".join(w.decode() for w in g) for g in groups], add_special_tokens=False)
            for g, e in zip(groups, found, strict=True):
                ids = np.array(e.ids, self.kind)
                ends = [*np.flatnonzero(ids == mark).tolist(), len(ids)]
                if len(ends) != len(g):
                    continue  # a word that makes a mark: all of them go alone
                start, data, size = 0, ids.tobytes(), ids.itemsize
                for w, end in zip(g, ends, strict=True):
                    of[w] = data[start * size : end * size]
                    start = end + 1
        alone = [w for w in words if w not in of]
        for j in range(0, len(alone), 4096):
            some = alone[j : j + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            of.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(some, found, strict=True))


_IDS: dict[int, Ids] = {}


def _ids_for(json: str, kind: str) -> Ids:
    key = zlib.crc32(json.encode())
    if key not in _IDS:
        _IDS.clear()
        _IDS[key] = Ids(json, kind)
    return _IDS[key]


def _tokenized(json, kind, end_id):
    def run(batches):
        ids_of, part = _ids_for(json.value, kind), TaskContext.get().partitionId()
        end = np.array([end_id], kind).tobytes()
        size, at = len(end), {}
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                ids = [x + end for x in ids_of(c.column(1).to_pylist())]
                n, start = [len(x) // size for x in ids], []
                for source, k in zip(c.column(2).to_pylist(), n, strict=True):
                    start.append(at.get(source, 0))
                    at[source] = start[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), c.column(2), pa.array([part] * len(n), pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "at", "n", "ids"],
                )

    return run


class Shares:
    """Tokens of each queue that the windows before a given one hold."""

    def __init__(self, totals: list[int], targets: list[float] | None, window: int):
        """totals: tokens of each queue. targets: weights, or None for the queues' own shares."""
        self.totals, self.window = totals, window
        weights = [round(1e6 * x) for x in targets] if targets else list(totals)
        served, x = [0] * len(totals), 0
        self.phases = []  # (first token, served before it, weights, their sum)
        while any(s < t for s, t in zip(served, totals, strict=True)):
            w = [k if s < t else 0 for k, s, t in zip(weights, served, totals, strict=True)]
            if not sum(w):
                w = [t - s for s, t in zip(served, totals, strict=True)]
            whole = sum(w)
            self.phases.append((x, served, w, whole))
            step = min(-(-(t - s) * whole // k) for k, s, t in zip(w, served, totals, strict=True) if k)
            served = [min(t, s + k * step // whole) for k, s, t in zip(w, served, totals, strict=True)]
            x += step
        self.end, self.starts = x, [p[0] for p in self.phases]
        self.memo: tuple[int, list[int]] = (-1, [])

    def one(self, queue: int, w: int) -> int:
        x = w * self.window
        if x >= self.end:
            return self.totals[queue]
        x0, served, weights, whole = self.phases[bisect.bisect_right(self.starts, x) - 1]
        return min(self.totals[queue], served[queue] + weights[queue] * (x - x0) // whole)

    def all(self, w: int) -> list[int]:
        if self.memo[0] != w:
            self.memo = w, [self.one(s, w) for s in range(len(self.totals))]
        return self.memo[1]

    def places(self, queue: int, first: int, n: int):
        """(tokens, global position) of the stretches that hold n tokens of a queue from its first-th."""
        low, high = 0, -(-self.end // self.window)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.one(queue, mid) <= first else (low, mid)
        while n:
            before = self.all(low)
            start, stop = before[queue], self.one(queue, low + 1)
            if stop > first:
                k = min(n, stop - first)
                ahead = sum(self.one(s, low + 1) - before[s] for s in range(queue))
                yield k, sum(before) + ahead + first - start
                first, n = first + k, n - k
            low += 1


class Nested:
    """Shares of any number of queues: each round-robin has about `most` queues, and a queue can be
    what a further round-robin deals out by the same weights, with its part of a window as window.
    Until a source runs dry all have the shares that they would have in one round-robin; then its part
    goes to those of its own round-robin."""

    def __init__(self, totals: list[int], targets: list[float] | None, window: int, most: int, named: set[int] | None = None):
        """named: sources that get a queue of the outermost round-robin whatever their size; those
        with a target unless given."""
        self.totals, self.most = totals, max(2, most)
        self.routes: list[tuple] = [()] * len(totals)  # (Shares, queue) from each source's own to the outermost
        named = {i for i, x in enumerate(targets or ()) if x > 0} if named is None else named
        largest = sorted(range(len(totals)), key=lambda i: (i not in named, -totals[i], i))
        own = sorted(largest[: max(most, len(named))])
        rest = sorted(set(largest).difference(own))
        part = sum(totals[i] for i in rest)
        outer = Shares([totals[i] for i in own] + [part] * bool(rest), [targets[i] for i in own] + [sum(targets[i] for i in rest)] * bool(rest) if targets else None, window)
        for k, i in enumerate(own):
            self.routes[i] = ((outer, k),)
        if rest:
            # within the rest a source weighs what it does outside of it; without any weight there, its tokens
            self.weights = targets if targets and any(targets[i] for i in rest) else totals
            beside = sum(self.weights) if self.weights is targets else sum(t for i, t in enumerate(totals) if i not in named)
            self._deal(rest, max(1, int(window * sum(self.weights[i] for i in rest) // beside)), ((outer, len(own)),))

    def _deal(self, ids: list[int], window: int, above: tuple) -> None:
        size = 1
        while size * self.most < len(ids):
            size *= self.most
        groups = [ids[k : k + size] for k in range(0, len(ids), size)]
        sums = [sum(self.totals[i] for i in g) for g in groups]
        weights = [sum(self.weights[i] for i in g) for g in groups]
        shares = Shares(sums, weights if self.weights is not self.totals else None, window)
        for k, g in enumerate(groups):
            route = ((shares, k), *above)
            if size == 1:
                self.routes[g[0]] = route
            else:
                self._deal(g, max(1, int(window * weights[k] // sum(weights))), route)

    def places(self, source: int, first: int, n: int):
        """As in Shares, in the outermost order."""
        yield from self._out(self.routes[source], first, n)

    def _out(self, route: tuple, first: int, n: int):
        shares, queue = route[0]
        for k, place in shares.places(queue, first, n):
            if len(route) == 1:
                yield k, place
            else:
                yield from self._out(route[1:], place, k)


def _pieces(shared, kind, length):
    def run(batches):
        size, shares = np.dtype(kind).itemsize, shared.value
        for b in batches:
            rows = []
            for doc, queue, base, at, n, ids in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                data = memoryview(np.frombuffer(ids, kind).astype("<u4").tobytes() if size != 4 else ids)
                done = 0
                for k, place in shares.places(queue, base + at, n):
                    while k:
                        some = min(k, length - place % length)
                        rows.append((doc, done, some, zlib.crc32(data[4 * done : 4 * (done + some)]), n, place // length, place % length))
                        done, place, k = done + some, place + some, k - some
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, [f.name for f in PIECES])

    return run


PIECES = T.StructType([T.StructField(x, T.LongType()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer_path: str, targets: dict[str | None, float] | None = None, temper: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, end_id: int = END_ID, window: int = WINDOW, queues: int = QUEUES) -> DataFrame:
    """The pieces of all documents. targets: token weight of each source (those not named weigh 0
    and come last). Without targets a source's weight is its tokens to the power `temper`: 1 keeps the
    proportions of the corpus in every window, less than 1 gives small sources more.

    One scan tokenizes and writes ids, with each document's place in its source's tokens of its own
    partition. Totals by source and partition (small: a row for each) give every partition its start
    in each queue; Spark joins them back, by broadcast only if their size allows. Texts and ids are
    never shuffled then. The driver holds the totals of the sources, a number for each.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path) as f:
        json = f.read()
    import json as parser

    kind = "<u2" if max(parser.loads(json)["model"]["vocab"].values(), default=0) < 2**16 and end_id < 2**16 else "<u4"
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    path = f"{scratch(spark)}/tokens-{os.urandom(8).hex()}"
    d.mapInArrow(_tokenized(spark.sparkContext.broadcast(json), kind, end_id), "doc_id long, source string, part long, at long, n long, ids binary").write.option("compression", "zstd").parquet(path)
    t = spark.read.parquet(path)

    per = t.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by_source = per.groupBy("source").agg(F.sum("n").alias("n"))
    sizes = {r.source: r.n for r in by_source.collect()}
    names = sorted(sizes, key=lambda x: (x is not None, x or ""))
    totals = [sizes[x] for x in names]
    weights = [float(targets.get(x, 0)) for x in names] if targets is not None else [t**temper for t in totals] if temper != 1 else None
    known = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "source string, queue int")
    per = per.join(known, per.source.eqNullSafe(known.source)).select(per.source, "part", "n", "queue")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(F.col("source").alias("s"), F.col("part").alias("p"), "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = cut(base, "starts")  # so that Spark knows its size before it plans the join
    placed = t.join(base, t.source.eqNullSafe(base.s) & (t.part == base.p)).select("doc_id", "queue", "base", "at", "n", "ids")
    shares = spark.sparkContext.broadcast(Nested(totals, weights, window, queues, None if targets is not None else set()))
    return placed.mapInArrow(_pieces(shares, kind, length), PIECES)
