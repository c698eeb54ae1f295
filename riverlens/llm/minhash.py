"""MinHash near-dedup: universal hash minima in bands, signature check, confirmation on full
shingle sets, connected components.

Defined cases: a text that is null, empty or without words has an empty set and is linked with
nothing; a text with fewer words than a shingle has one shingle, its whole word sequence; very long
texts are read whole; repeated rows count as copies of each other; an id with several texts is one
document that is linked through each of them; a row with a null id is linked with nothing and kept;
an empty table gives an empty result. Columns other than the id and the text are ignored by
near_duplicates() and kept by drop_near_duplicates(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, gram_hashes, hashes_of, mix, odd_constants, ship
from .components import components

WORDS, PERCENT = 5, 75
ROWS, BANDS = 4, 32
#: Least share of equal minima for a pair to be confirmed on full sets: five standard deviations
#: below the threshold for 128 minima.
LEAST_SHARE = 0.55
#: Shingles of a block: the members of a bucket are compared block by block.
BLOCK = 100_000

_COEFF = odd_constants(64, 11)
_A, _B = odd_constants(ROWS * BANDS, 12)[:, None], odd_constants(ROWS * BANDS, 13)[:, None]
_CACHE = WordHashes()


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted 64-bit hashes. ASCII letters are lower-cased
    and words end at ASCII white space, which is what bytes.lower() and bytes.split() do."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes_of(words, _CACHE)
    if len(h) < k:
        return mix((h * _COEFF[: len(h)]).sum(dtype=np.uint64, keepdims=True) + _COEFF[32 + len(h)])
    return np.unique(gram_hashes(h, k, _COEFF))


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function over a set, its top 16 bits."""
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 4096):
        for j in range(0, ROWS * BANDS, 32):
            part = (_A[j : j + 32] * s[i : i + 4096] + _B[j : j + 32]).min(axis=1)
            np.minimum(least[j : j + 32], part, out=least[j : j + 32])
    return (least >> np.uint64(48)).astype("<u2")


def _features(batches, k):
    for b in batches:
        n, fp, fp2, sig = [], [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text, k)
            n.append(len(s))
            fp.append(mix(s).sum(dtype=np.uint64))
            fp2.append((s * _COEFF[40] + s * s).sum(dtype=np.uint64))
            sig.append(signature(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).astype(np.int64)) for x in (fp, fp2)), pa.array(sig, pa.binary())], ["doc_id", "th", "n_shingles", "fp", "fp2", "sig"])


def _minima(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, ROWS * BANDS)


def _sizes_fit(x, y, percent: int):
    """Sets of these sizes can be that similar."""
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _alike(percent):
    """Pairs whose sizes and signatures agree well enough."""

    def run(batches):
        for b in batches:
            keep = (_minima(b.column(2)) == _minima(b.column(4))).mean(axis=1) >= LEAST_SHARE
            keep &= _sizes_fit(b.column(3).to_numpy(), b.column(5).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    return run


def _confirmed(k, percent):
    def run(batches):
        kept: dict[str, np.ndarray] = {}
        for b in batches:
            ok = []
            for ta, tb in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if tb not in kept:
                    if len(kept) > 64:
                        kept.clear()
                    kept[tb] = shingle_set(tb, k)
                x, y = shingle_set(ta, k), kept[tb]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return run


def joins(band: int, side: np.ndarray, comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links between two blocks of one bucket join, at most one fewer than
    there are components. side: 0 and 1 for the members of two blocks, 2 for those of one block that
    is compared with itself. A pair of members is looked at in the first band that they share, and only
    while its components are not joined."""
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    bands = np.ascontiguousarray(sig).view("<u8")
    mark, label, out = np.zeros(ids.max(initial=0) + 1, bool), comp.copy(), []
    for i in np.flatnonzero(side != 1):
        other = (np.arange(len(side)) > i) if side[i] == 2 else side == 1
        y = np.flatnonzero(other & (label != label[i]) & _sizes_fit(size, size[i], percent))
        y = y[(sig[y] == sig[i]).mean(axis=1) >= LEAST_SHARE]
        if len(y):
            shared = bands[y] == bands[i]
            y = y[shared[:, band] & (shared.argmax(axis=1) == band)]
        if not len(y):
            continue
        own = ids[ends[i] - size[i] : ends[i]]
        mark[own] = True
        for j in y:
            if label[j] != label[i]:
                both = int(mark[ids[ends[j] - size[j] : ends[j]]].sum())
                if both and 100 * both >= percent * (size[i] + size[j] - both):
                    out.append((int(label[i]), int(label[j])))
                    label[label == label[j]] = label[i]
        mark[own] = False
    return out


def _joins(k, percent):
    """joins() of each row: a bucket's key, sides and (component, signature, text) of its members."""

    def run(batches):
        for b in batches:
            found: list[tuple[int, int]] = []
            rows, start = b.column(1), 0
            flat = rows.flatten()
            side, comp = flat.field("side").to_numpy(), flat.field("comp").to_numpy()
            sig, text = flat.field("sig"), flat.field("text")
            for key, n in zip(b.column(0).to_pylist(), rows.value_lengths().to_pylist(), strict=True):
                own = slice(start, start + n)
                sets = [shingle_set(t, k) for t in text[own].to_pylist()]
                found += joins(key & (BANDS - 1), side[own], comp[own], _minima(sig[own]), sets, percent)
                start += n
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def buckets(classes: DataFrame) -> DataFrame:
    """(band, doc, n): the buckets of n > 1 classes. A bucket's key ends with the number of its band."""
    width = 2 * ROWS
    key = f"xxhash64(i, substring(sig, cast(i * {width} + 1 as int), {width})) & -{BANDS} | i"
    banded = classes.select(F.explode(F.expr(f"transform(sequence(0L, {BANDS - 1}L), i -> {key})")).alias("band"), F.col("rep").alias("doc"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return banded.join(shared, "band")


def _with_leader(members: DataFrame) -> DataFrame:
    """(a, b): each class with the leader of each of its buckets. A bucket's leader is the member
    whose own buckets are the largest: of a group of near copies that is the one most of them were
    made from, as it shares more bands with them than they do with each other."""
    weight = members.groupBy("doc").agg(F.sum("n").alias("w"))
    leaders = members.join(weight, "doc").groupBy("band").agg(F.max(F.struct("w", (-F.col("doc")).alias("d"))).alias("m"))
    pairs = members.join(leaders.select("band", (-F.col("m.d")).alias("b")), "band").where("doc <> b")
    return pairs.select(F.col("doc").alias("a"), "b").distinct()


def _mixed(members: DataFrame, found: DataFrame, cards: DataFrame) -> DataFrame:
    """(band, rows): pairs of blocks of the buckets that the links found leave in several components;
    of buckets with the same members the one of the first band. Members are dealt to blocks of a
    bounded number of shingles, so that a bucket of any size is compared in many tasks."""
    m = members.drop("n").join(found, members.doc == found.node, "left").select("band", "doc", F.coalesce("component", "doc").alias("comp"))
    m = cut(m.join(cards.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("size")), "doc"), "members-with-components")
    per = m.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("size").alias("size"), F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("doc", F.lit(j))).alias(f"who{j}") for j in (0, 1)))
    first = per.where("lo < hi").groupBy("who0", "who1", "n", "size").agg(F.min(F.struct((F.col("band").bitwiseAND(BANDS - 1)).alias("i"), "band")).alias("f"))
    first = first.select(F.col("f.band").alias("band"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    m = m.drop("size").join(first, "band").join(cards.select(F.col("rep").alias("doc"), "sig", "text"), "doc")
    m = m.withColumn("own", F.expr("cast(pmod(xxhash64(doc, 'block'), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    row = F.struct(side.cast("long").alias("side"), "comp", "sig", "text")
    return m.groupBy("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(row).alias("rows")).select("band", "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    1. One scan makes each document's shingle set, its 128 minima and a fingerprint of the set.
    2. Documents with one set are one class; its least id stands for it from here on.
    3. Bands of the minima put classes into buckets. Each class is compared with the leaders of its
       buckets: sizes and signatures, then the full sets. Components of these links.
    4. Only buckets that are still in several components are looked at again, block by block inside
       of tasks, and only pairs of different components; a task gives back at most one link a member.
    5. Components of the components that those links join. All by alternating stars.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    f = cut(d.mapInArrow(lambda it: _features(it, k), "doc_id long, th long, n_shingles long, fp long, fp2 long, sig binary"), "features")
    classes = f.where("n_shingles > 0 and doc_id is not null").groupBy("fp", "fp2", "n_shingles").agg(F.min(F.struct("doc_id", "th")).alias("m"), F.first("sig").alias("sig"))
    classes = cut(classes.select("fp", "fp2", "n_shingles", F.col("m.doc_id").alias("rep"), F.col("m.th").alias("th"), "sig"), "classes")

    members = cut(buckets(classes), "members")
    pairs = cut(_with_leader(members), "pairs")
    sig = classes.select("rep", "sig", "n_shingles")
    alike = pairs.join(sig.toDF("a", "sa", "na"), "a").join(sig.toDF("b", "sb", "nb"), "b").select("a", "b", "sa", "na", "sb", "nb")
    alike = cut(alike.mapInArrow(_alike(percent), "a long, b long"), "alike")

    own = classes.join(members.select(F.col("doc").alias("rep")).distinct(), "rep").select("rep", "th", "n_shingles", "sig")
    cards = own.join(d, (d.doc_id == own.rep) & (d.th == own.th)).select("rep", own.th, "n_shingles", "sig", "text").dropDuplicates(["rep", "th"])
    cards = cut(cards, "cards")
    text = cards.select("rep", "text")
    full = alike.join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    found = cut(components(full.mapInArrow(_confirmed(k, percent), "a long, b long")), "components")

    more = cut(_mixed(members, found, cards).mapInArrow(_joins(k, percent), "a long, b long"), "joins")
    if not more.isEmpty():
        up = components(more)
        below = found.join(up.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        alone = up.join(found, "node", "left_anti")
        found = cut(below.union(alone), "components")

    c = classes.join(found, classes.rep == found.node, "left").select("fp", "fp2", F.col("n_shingles").alias("size"), F.coalesce("component", "rep").alias("component"))
    same = (f.fp == c.fp) & (f.fp2 == c.fp2) & (f.n_shingles == c["size"])
    out = f.select("doc_id", "n_shingles", "fp", "fp2").join(c, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **args) -> DataFrame:
    """One document of each component, all columns; of repeated rows of an id one, of those without an
    id all."""
    key = args.get("id_col", "doc_id")
    ids = near_duplicates(docs, **args).where("kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    kept = docs.where(F.col(key).isNotNull()).join(ids, docs[key].cast("long") == ids["id"], "left_semi")
    return kept.dropDuplicates([key]).union(docs.where(F.col(key).isNull()))
