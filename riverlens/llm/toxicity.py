"""Toxicity by compression distance: a zstandard dictionary of toxic windows and one of ordinary
windows, window lengths under both, calibrated thresholds.

The toxic dictionary holds windows of toxic documents only, those that toxic documents have far more
often; the ordinary one holds the most frequent windows of the other documents. Each window of a text
is compressed once with either; by how many bytes the toxic dictionary does better, if it does, is the window's
distance. How many windows of a text pass each distance is calibrated, on labelled documents that
made neither dictionary, to a probability.

Defined cases: a null or empty text has one empty window and gets the score of that; a very long text
is read whole, window by window; while only one label (or none) is known, every score is that label
(or 0); rows with a null id or label are not learned from; an id with two labels counts as toxic, one
with several texts lends its label to the first in order; a null id is not held out; repeated rows are scored alike; an empty table gives an empty result. Columns
other than id and text are ignored by classify() and kept by drop_toxic(), whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: Labelled documents learned from, at most.
SAMPLE = 5000
#: Words of a scored window; windows follow each other. Dictionaries are made of one-word windows.
WINDOW, LEVEL = 2, 9
#: Bytes of each dictionary: the size of the model.
ORDINARY_SIZE, TOXIC_SIZE = 32_768, 16_384
#: A toxic window is in at least so many toxic documents, and in a share of them that is at least so
#: many times its share of the others.
LEAST_DOCS, TIMES = 3, 16
#: One sampled document in so many calibrates; the others make the dictionaries.
CALIBRATES = 3
DISTANCES = (1, 2, 3, 4, 5, 6, 8)
#: False alarms that a missed toxic document counts as when the score is calibrated.
MISS = 3
#: Windows that a task keeps the distances of.
KNOWN = 100_000
#: Both dictionaries and every window end with this: the compressor looks for no match that begins in
#: the last bytes of its input, and stores very short inputs as they are.
TAIL = b"0123456789ABCDEFGHIJKLMNOPQRSTUV"
_TRIM = b".,!?:;|#$%&*\"'()"


def words_of(text: str | None) -> list[bytes]:
    return [w.strip(_TRIM) for w in text.encode("utf-8", "surrogatepass").lower().split()] if text else []


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """size words each, one after the other; the last has what is left."""
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, max(1, len(words)), size)]


class Scorer:
    """Two compressors and a calibration; small enough to broadcast (dictionaries of bounded size)."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray | None = None, constant: float = 0.0):
        self.toxic, self.ordinary, self.weights, self.constant = toxic, ordinary, weights, constant
        self._made, self._known = None, {}

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights, self.constant

    def __setstate__(self, state):
        self.__init__(*state)

    def _compressors(self):
        if self._made is None:
            made = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            # bytes that a window takes besides its own where nothing of it is found
            self.nothing = len(made[1](b"\xff\xfe\xfd\xfc\xfb\xfa\xf9\xf8" + TAIL)) - 8
            self._made = made
        return self._made

    def distances(self, text: str | None) -> np.ndarray:
        """For each window, the bytes by which the toxic dictionary does better, at least 0. Where it
        finds nothing in a window the ordinary one can't do worse, and is not asked. A task keeps
        the distances of the windows it has seen, up to a bound."""
        ordinary, toxic = self._compressors()
        own, known, nothing = windows(words_of(text)), self._known, self.nothing
        new = set(own).difference(known)
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = set(own)
        for w in new:
            x = w + TAIL
            n = len(toxic(x))
            known[w] = max(0, len(ordinary(x)) - n) if n < len(w) + nothing else 0
        return np.fromiter(map(known.__getitem__, own), np.int64, len(own))

    def forget(self) -> None:
        """At the end of a task: its worker goes on to other stages."""
        self._known.clear()

    def features(self, text: str | None) -> np.ndarray:
        d = self.distances(text)
        top = -np.sort(-(np.partition(d, len(d) - 10)[-10:] if len(d) > 10 else d))
        past = [int((d >= k).sum()) for k in DISTANCES]
        return np.array([top[0], top[:3].sum() / 3, top.sum() / 10, d.mean(), *map(math.log1p, past), *(x / len(d) for x in past)])

    def calibrate(self, features: list[list[float]], labels: list[int], rounds: int = 25, ridge: float = 1e-3) -> None:
        """Logistic regression on the features, by Newton steps; a toxic document counts MISS times."""
        x, y = np.array(features), np.array(labels, float)
        weight = np.where(y > 0, float(MISS), 1.0)
        mean, spread = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - mean) / spread, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(w))
            w -= np.linalg.solve(h, z.T @ (weight * (p - y)) + ridge * len(y) * w)
        self.weights = np.r_[w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum()]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.constant
        return float(1 / (1 + math.exp(-min(30.0, max(-30.0, float(self.features(text) @ self.weights[:-1] + self.weights[-1]))))))


def _counted(batches):
    """window, toxic documents and other documents of the batch that hold it."""
    for b in batches:
        found = (Counter(), Counter())
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found[y].update(set(windows(words_of(t), 1)))
        all_ = list(found[0] | found[1])
        cols = [pa.array(all_, pa.binary()), *(pa.array([found[y][x] for x in all_], pa.int64()) for y in (1, 0))]
        yield pa.RecordBatch.from_arrays(cols, ["win", "a", "b"])


def _content(rows: list, size: int) -> bytes:
    """The first windows up to a size, the first of them last, where references are cheapest."""
    out, n = [], 0
    for r in rows:
        n += len(r.win)
        if n > size:
            break
        out.append(bytes(r.win))
    return b"".join(reversed(out))


def dictionaries(some: DataFrame, docs: tuple[int, int]) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary, from texts with labels y. docs: ordinary
    and toxic documents. Windows are counted in tasks; the driver receives what fits a dictionary."""
    n = some.select("text", "y").mapInArrow(_counted, "win binary, a long, b long").groupBy("win").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = cut(n, "toxicity-windows")
    telling = n.where(F.col("a") >= LEAST_DOCS).where(F.col("a") * docs[0] > TIMES * F.col("b") * docs[1])
    toxic = telling.orderBy(F.desc("a"), "win").limit(TOXIC_SIZE // 2).collect()
    usual = n.where("b > 1").orderBy(F.desc("b"), "win").limit(ORDINARY_SIZE // 2).collect()
    return _content(toxic, TOXIC_SIZE), _content(usual, ORDINARY_SIZE)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """A scorer from at most about `sample` labelled documents, the first by a hash of their id, each
    read whole in tasks. Documents that made the dictionaries look more toxic (or ordinary) than new
    ones, so others calibrate (the same where those lack a label). The driver receives dictionary
    windows and rows of features."""
    spark = docs.sparkSession
    ship(spark)
    y = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    chosen = y.orderBy(F.xxhash64(F.col("id"), F.lit("toxicity")), "id").limit(sample)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some = d.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    some = cut(some.repartition(4 * spark.sparkContext.defaultParallelism, "id"), "toxicity-sample")
    calibrates = F.pmod(F.xxhash64(F.col("id"), F.lit("calibrates")), F.lit(CALIBRATES)) == 0
    count: Counter = Counter()
    own: Counter = Counter()
    for r in some.groupBy("y", calibrates.alias("c")).count().collect():
        count[r.y] += r["count"]
        own[r.y] += r["count"] * r.c
    if len(count) < 2:
        return Scorer(b"", b"", constant=float(max(count, default=0)))
    apart = all(0 < own[k] < count[k] for k in (0, 1))
    taught, rest = (some.where(~calibrates), some.where(calibrates)) if apart else (some, some)
    scorer = Scorer(*dictionaries(taught, tuple(count[k] - own[k] if apart else count[k] for k in (0, 1))))
    raw = spark.sparkContext.broadcast(scorer)

    def measured(batches):
        s = raw.value
        for b in batches:
            x = [s.features(t).tolist() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])
        s.forget()

    rows = sorted(rest.select("id", "y", "text").mapInArrow(measured, "id long, y int, x array<double>").collect(), key=lambda r: r.id)
    scorer.calibrate([r.x for r in rows], [r.y for r in rows])
    return scorer


def predict(docs: DataFrame, scorer: Scorer, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns `keep`, score and predicted of every row, in one scan."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches):
        s = shared.value
        for b in batches:
            p = [s.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *cols], [*b.schema.names[:-1], "score", "predicted"])
        s.forget()

    d = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = d.drop("_text").schema.add("score", "double").add("predicted", "integer")
    return d.mapInArrow(run, schema)


def held_out(docs: DataFrame, fold: int = 5, rest: int = 0, id_col: str = "doc_id"):
    """True for ids whose CRC-32 as text leaves a given rest; their labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % fold == rest, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scorer = learn(docs, labels.where(~held_out(labels, id_col=id_col)), id_col, text_col, label_col)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(docs, id_col=id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(d, scorer, "text", ("doc_id", "held_out"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **cols) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    scorer = learn(docs, labels.where(~held_out(labels)), text_col=text_col, **cols)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)

    def run(batches):
        s = shared.value
        for b in batches:
            yield b.filter(pa.array([s.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))
        s.forget()

    return docs.mapInArrow(run, docs.schema)
