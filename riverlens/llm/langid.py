"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps in each slot a bit for each language; the slots of an n-gram, ANDed,
give all languages that contain it. A text's popcount per language, less the false positives that the
language's share of set bits makes expect, decides.

Defined cases: a text that is null or has no letter is `und` with score 0, as is any text while
nothing is learned; a text of which no n-gram is known gets the language of most documents with score
0; ties go to the language first by name; rows with a null id or language are not learned from, and a
null id is not held out; very long texts are read whole; repeated rows are predicted alike; an empty
table gives an empty result.
Columns other than id, text and language are ignored.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, odd_constants, ship

GRAM, SLOT_BITS, HASHES = 4, 20, 3
#: The filters are learned from about SAMPLE documents of each language, chosen by a hash of the id,
#: and hold each language's GRAMS most frequent n-grams, of all languages.
SAMPLE, GRAMS = 1500, 20_000
_COEFF = odd_constants(GRAM, 31)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool)


def gram_hashes(text: str | None) -> np.ndarray | None:
    """Hashes of the character n-grams of a text in lower case with all else than letters as single
    spaces, also around it; None without letters."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.concatenate([[32], np.where(letter, c, 32), [32]]).astype(np.uint64)
    gap = c == 32
    c = c[~(gap & np.r_[False, gap[:-1]])]
    n = len(c) - GRAM + 1
    if n <= 0:
        c, n = np.concatenate([c, np.full(GRAM, 32, np.uint64)])[:GRAM], 1
    h = c[:n] * _COEFF[0]
    for j in range(1, GRAM):
        h += c[j : j + n] * _COEFF[j]
    return mix(h)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(j * SLOT_BITS)) & np.uint64(2**SLOT_BITS - 1)).astype(np.int64) for j in range(HASHES)]


class Filters:
    def __init__(self, grams: dict[str, np.ndarray], docs: dict[str, int]):
        """grams: the n-gram hashes of each language; docs: its documents."""
        self.langs = sorted(grams)
        n = len(self.langs)
        kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 10**9)) if n <= bits)
        self.width = np.dtype(kind).itemsize * 8
        self.planes = [np.zeros(2**SLOT_BITS, kind) for _ in range(max(1, -(-n // self.width)))]
        self.chance = np.zeros(n)
        for i, lang in enumerate(self.langs):
            plane, bit = self.planes[i // self.width], kind(1 << i % self.width)
            for s in _slots(grams[lang]):
                plane[s] |= bit
            self.chance[i] = ((plane & bit) != 0).mean() ** HASHES
        self.usual = max(self.langs, key=lambda x: (docs[x], x), default="und")

    def predict(self, text: str | None) -> tuple[str, float]:
        h = gram_hashes(text)
        if h is None or not self.langs:
            return "und", 0.0
        slots = _slots(h)
        counts = []
        for plane in self.planes:
            masks = functools.reduce(np.bitwise_and, (plane[s] for s in slots))
            if self.width == 8:
                per = np.bincount(masks, minlength=256)
                counts += [int(per[np.arange(256) >> b & 1 == 1].sum()) for b in range(8)]
            else:
                counts += [int(((masks >> plane.dtype.type(b)) & plane.dtype.type(1)).sum()) for b in range(self.width)]
        seen = np.array(counts[: len(self.langs)], float)
        real = np.maximum(0, (seen - len(h) * self.chance) / (1 - self.chance))
        if not real.sum():
            return self.usual, 0.0
        i = int(real.argmax())
        return self.langs[i], float(real[i] / real.sum())


def _counted(batches):
    """lang, n-gram, its count in the batch."""
    for b in batches:
        for lang in set(b.column(0).to_pylist()):
            texts = [t for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x == lang]
            h = [x for x in map(gram_hashes, texts) if x is not None]
            if h:
                g, n = np.unique(np.concatenate(h), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "g", "n"])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Filters:
    """Filters from docs. The driver receives at most GRAMS n-grams for each language."""
    ship(docs.sparkSession)
    d = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    d = d.where("lang is not null and text is not null and id is not null")
    docs_of = {r.lang: r.n for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not docs_of:
        return Filters({}, {})
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, SAMPLE / n)) for k, n in docs_of.items()], "lang string, rate double")
    some = d.join(F.broadcast(rates), "lang").where("pmod(xxhash64(id, 'language'), 1000000) / 1000000d < rate")
    per = some.select("lang", "text").mapInArrow(_counted, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = per.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(F.col("k") <= GRAMS)
    rows = top.select("lang", "g").toPandas()
    return Filters({k: x.g.to_numpy(np.int64).astype(np.uint64) for k, x in rows.groupby("lang")}, docs_of)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score of every row, in one scan; the filters are broadcast,
    2**SLOT_BITS slots of a bit for each language."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(filters)

    def run(batches):
        f = shared.value
        for b in batches:
            found = [f.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *cols], [*b.schema.names[:-1], "lang_pred", "score"])

    d = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = d.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return d.mapInArrow(run, schema)


def held_out(docs: DataFrame, fold: int = 3, rest: int = 1, id_col: str = "doc_id"):
    """True for ids whose CRC-32 as text leaves a given rest; they are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % fold == rest, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    filters = learn(docs.where(~held_out(docs, id_col=id_col)), lang_col, text_col, id_col)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(docs, id_col=id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(d, filters, "text", ("doc_id", "held_out"))
