"""Substring dedup: a count-min sketch finds the windows that may be repeated, a second pass groups
exactly those. Words are compared by the first 128 bits of their SHA-256.

A window is 35 consecutive words. Windows with one word sequence have one minimizer (the word 8-gram
with the least hash, the leftmost of equals) at one place in them, so the sketch counts each window
under its minimizer: its estimate is never below the window's own count. Consecutive windows with one
minimizer are a run. Each task fills a count-min array of its own; the arrays are merged by ranges of
cells, and the bits of the cells with two or more, of a bounded size, go to all tasks.

Defined cases: a null or empty text has no words, n_words 0 and the digest of the empty string; texts
shorter than a window lose nothing; very long texts are read whole, a document at a time; repeated rows
are places like any other, so both copies lose their words; rows are told apart by id and text, so an
id with several texts has the spans of each, and rows without an id go by their text; an empty table
gives an empty result. Other columns are kept by remove_repeats() and ignored by removal(), whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, gram_hashes, hashes_of, mix, odd_constants, ship

WINDOW, GRAM = 35, 8
#: Rows of the count-min sketch; cells of a row as a power of two, at most, and cells for each
#: minimizer below that. 26 bits are 8 MB for each row that go to every task. Where a corpus fills the
#: sketch, more windows go on to the exact pass, and none is lost.
DEPTH, WIDTH_BITS, SPARE = 2, 26, 8
#: Characters of text for each minimizer, about.
CHARS = 60
#: Ranges of cells that the arrays are merged by, and groups of tasks that are merged first.
RANGES, GROUPS = 64, 16
#: Bytes of a SHA-256 that runs and windows are compared by, and bits at most, as a power of two, of the
#: sets of keys that go to all tasks (32 MB).
DIGEST, SET_BITS = 16, 28
#: Rows of a batch that a task unpacks at once, minimizers that it counts at once, and rows of its own
#: that it gives on at once.
PIECE, COUNTED, GIVEN = 256, 250_000, 20_000

_COEFF = odd_constants(512, 21)
_CACHE = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words end at ASCII white space only, which is how bytes.split() works."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def pieces(batches):
    """Slices of batches: lists of Python's take several times the room of a batch, and workers keep
    what they once took."""
    for b in batches:
        for i in range(0, b.num_rows, PIECE):
            yield b.slice(i, PIECE)


def runs_of(words: list[bytes], window: int, gram: int):
    """For each run of windows: minimizer, its place, first window, windows."""
    n = len(words) - window + 1
    if n <= 0:
        return None
    g = gram_hashes(hashes_of(words, _CACHE), gram, _COEFF)
    at = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return g[at[first]], at[first], first, np.diff(np.r_[first, n])


# --- the sketch


def cells(minimizers: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each minimizer in each row of the sketch."""
    return [(mix(minimizers + _COEFF[300 + j]) >> np.uint64(64 - bits)).astype(np.int64) for j in range(DEPTH)]


def count(sketch: np.ndarray, minimizers: np.ndarray) -> None:
    """Add minimizers to a sketch of DEPTH rows, whose counts stop at 2."""
    bits = sketch.shape[1].bit_length() - 1
    for row, c in zip(sketch, cells(minimizers, bits), strict=True):
        at, n = np.unique(c, return_counts=True)
        row[at] = np.minimum(2, row[at] + np.minimum(n, 2)).astype(np.uint8)


def _sketch_of_task(bits, window, gram):
    """The task's own sketch, a row for each range of cells that has any."""

    def run(batches):
        from pyspark import TaskContext

        sketch, found, size = np.zeros((DEPTH, 1 << bits), np.uint8), [], 0
        for b in pieces(batches):
            for text in b.column(0).to_pylist():
                r = runs_of(words_of(text), window, gram)
                if r:
                    found.append(r[0])
                    size += len(r[0])
                if size > COUNTED:
                    count(sketch, np.concatenate(found))
                    found, size = [], 0
        if found:
            count(sketch, np.concatenate(found))
        group, pack = TaskContext.get().partitionId() % GROUPS, zstandard.ZstdCompressor(level=1).compress
        for j, row in enumerate(sketch):
            for k, part in enumerate(row.reshape(RANGES, -1)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([j * RANGES + k]), pa.array([group]), pa.array([pack(part.tobytes())], pa.binary())], ["range", "grp", "counts"])

    return run


def _merge(batches):
    """The sums of consecutive rows of one range (and group), one array in memory at a time."""
    now, total = None, None
    pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([pack(total.tobytes())], pa.binary())], ["range", "grp", "counts"])

    for b in batches:
        for k, g, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            own = np.frombuffer(unpack(blob), np.uint8)
            if (k, g) != now:
                if now is not None:
                    yield out()
                now, total = (k, g), own.copy()
            else:
                np.minimum(2, total + own, out=total)
    if now is not None:
        yield out()


def repeated_cells(docs: DataFrame, text_col: str, window: int, gram: int, width_bits: int = WIDTH_BITS) -> tuple[int, bytes]:
    """Bits of a cell's number, and for each row and cell a bit: counted twice or more. The width goes
    with the corpus's characters up to 2**width_bits."""
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    bits = min(width_bits, max(12, int(SPARE * chars / CHARS).bit_length()))
    schema = "range long, grp long, counts binary"
    parts = cut(docs.select(text_col).mapInArrow(_sketch_of_task(bits, window, gram), schema), "sketches")
    parts = parts.repartition("range", "grp").sortWithinPartitions("range", "grp").mapInArrow(_merge, schema)
    parts = parts.withColumn("grp", F.lit(0).cast("long")).repartition("range").sortWithinPartitions("range").mapInArrow(_merge, schema)
    heavy = np.zeros((DEPTH * RANGES, (1 << bits) // RANGES), bool)
    for r in parts.toLocalIterator():
        heavy[r["range"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), np.uint8) > 1
    return bits, np.packbits(heavy.reshape(-1), bitorder="little").tobytes()


def maybe_repeated(minimizers: np.ndarray, bits: int, heavy: np.ndarray) -> np.ndarray:
    """True where the sketch's estimate is two or more."""
    ok = np.ones(len(minimizers), bool)
    for j, c in enumerate(cells(minimizers, bits)):
        c = c + (j << bits)
        ok &= (heavy[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
    return ok


# --- the exact pass


def _runs(shared, bits, window, gram):
    """Runs whose minimizer may be repeated, with the digest of their words and of the minimizer's place."""

    def run(batches):
        heavy = np.frombuffer(shared.value, np.uint8)
        for b in pieces(batches):
            out = ([], [], [], [], [])
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                r = runs_of(words, window, gram)
                if not r:
                    continue
                keep = maybe_repeated(r[0], bits, heavy)
                for m, at, first, n in zip(*(x[keep].tolist() for x in r), strict=True):
                    digest = hashlib.sha256(b"%d " % (at - first) + b" ".join(words[first : first + n + window - 1])).digest()[:DIGEST]
                    for x, v in zip(out, (row, m, digest, first, n), strict=True):
                        x.append(v)
                if len(out[0]) > GIVEN:
                    yield _run_batch(out)
                    out = ([], [], [], [], [])
            yield _run_batch(out)

    return run


def _run_batch(out):
    cols = [pa.array(out[0], pa.int64()), pa.array(np.array(out[1], np.uint64).astype(np.int64)), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32())]
    return pa.RecordBatch.from_arrays(cols, ["row", "m", "d", "start", "windows"])


def _windows(window):
    """The windows of given runs, each with the digest of its words."""

    def run(batches):
        for b in pieces(batches):
            out = ([], [], [], [])
            for row, text, runs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                for r in runs:
                    for i in range(r["start"], r["start"] + r["windows"]):
                        for x, v in zip(out, (row, hashlib.sha256(b" ".join(words[i : i + window])).digest()[:DIGEST], i, r["single"]), strict=True):
                            x.append(v)
                if len(out[0]) > GIVEN:
                    yield _batch(out)
                    out = ([], [], [], [])
            yield _batch(out)

    return run


def _batch(cols):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.bool_()), strict=True)], ["row", "w", "start", "single"])


def holds(keys: DataFrame, key: Column) -> Callable[[np.ndarray], np.ndarray]:
    """A test for arrays of longs inside of tasks: true for all that `key` gives in a written table, and for few others.
    A bit for each cell of the keys goes to all tasks, so rows that meet nothing stay out of a
    shuffle; a set with more keys than its bits are made for lets more rows pass, and loses none."""
    spark = keys.sparkSession
    bits = min(SET_BITS, max(15, (8 * keys.count()).bit_length()))
    at = F.pmod(key, F.lit(1 << bits)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    cell = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        cell[(r["part"] - 1) * len(own) : r["part"] * len(own)] = own
    shared = spark.sparkContext.broadcast(cell.tobytes())

    def held(x: np.ndarray) -> np.ndarray:
        c = x & ((1 << bits) - 1)
        return (np.frombuffer(shared.value, np.uint8)[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)

    return held


def tested(held: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """What holds() gives, for columns. A stage that has a Python step already calls held() in it: each
    step more is a worker more for each core, which stays."""

    @F.arrow_udf("boolean")
    def test(x: pa.Array) -> pa.Array:
        return pa.array(held(x.to_numpy(zero_copy_only=False)))

    return test


def among(keys: DataFrame, key: Column) -> Callable[[Column], Column]:
    return tested(holds(keys, key))


def _mask(n: int, spans, window: int) -> np.ndarray:
    """True for the words that a repeated window covers."""
    gone = np.zeros(n + 1, np.int64)
    for s in spans or ():
        gone[min(n, s["start"])] += 1
        gone[min(n, s["start"] + s["windows"] + window - 1)] -= 1
    return np.cumsum(gone[:n]) > 0


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, key = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    return docs.select(F.xxhash64(key, text).alias("row"), text.alias("text"), key.alias("doc_id"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, width_bits: int = WIDTH_BITS) -> DataFrame:
    """(row, spans): for each row with a repeated window, arrays of (start, windows).

    1. Each task counts its minimizers in a count-min array; merged, they leave the bits of the cells
       with two or more.
    2. Each task writes the runs whose minimizer has such cells only; no other window is repeated, and
       none of them enters a shuffle.
    3. Exactly: runs with equal words are repeated as a whole. Runs that are not, but share their
       minimizer, are compared window by window with one copy of each other run. Counts are summed
       before their shuffles, so a passage in a third of all documents costs a row a task; the joins
       that bring counts back are between written tables, which Spark splits where a key is hot.
       Texts and windows that meet nothing in such a join are left out of its shuffle. A stage has one
       Python step, which unpacks its batches piece by piece.
    """
    spark = docs.sparkSession
    ship(spark)
    d = _numbered(docs, id_col, text_col)
    bits, heavy = repeated_cells(d, "text", window, gram, width_bits)
    shared = spark.sparkContext.broadcast(heavy)
    maybe = cut(d.select("row", "text").mapInArrow(_runs(shared, bits, window, gram), "row long, m long, d binary, start int, windows int"), "maybe")

    place = F.struct("row", "start", "windows")
    same = cut(maybe.groupBy("m", "d").agg(F.count("*").alias("n"), F.min(place).alias("one")), "same")
    unsure = same.groupBy("m").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("m")
    look = same.join(unsure, "m", "left_semi").select("one.*", (F.col("n") == 1).alias("single"))
    look = cut(look.groupBy("row").agg(F.collect_list(F.struct("start", "windows", "single")).alias("runs")), "look")
    wins = d.where(among(look, F.col("row"))("row")).dropDuplicates(["row"]).join(look, "row").select("row", "text", "runs").mapInArrow(_windows(window), "row long, w binary, start int, single boolean")
    wins = cut(wins, "windows")
    twice = cut(wins.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w"), "twice")
    by_window = wins.where("single").where(among(twice, F.xxhash64("w"))(F.xxhash64("w"))).join(twice, "w", "left_semi").select("row", "start", F.lit(1).alias("windows"))
    by_run = maybe.join(same.where("n > 1").select("d"), "d", "left_semi").select("row", "start", "windows")
    return by_run.union(by_window).groupBy("row").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    spans = cut(repeated_spans(docs, id_col, text_col, window, gram), "spans")
    d = _numbered(docs, id_col, text_col)

    held = holds(spans, F.col("row"))

    def run(batches):
        for b in pieces(batches):
            n, gone, sha = [], [], []
            for text, sp in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text)
                n.append(len(words))
                if sp:
                    mask = _mask(len(words), sp, window)
                    words = [words[i] for i in np.flatnonzero(~mask)]
                gone.append(n[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    def whole(batches):
        for b in pieces(batches):
            b = b.filter(pa.array(~held(b.column(2).to_numpy(zero_copy_only=False))))
            yield from run([pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(b.num_rows)], ["doc_id", "text", "spans"])])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    # a merge join, so that a shuffle stands between the two Python steps
    lose = d.where(tested(held)("row")).join(spans.hint("merge"), "row", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
    return lose.union(d.select("doc_id", "text", "row").mapInArrow(whole, schema))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the repeated windows' words taken out. A text that loses nothing stays as it is; in
    the others the words left are joined by one space. All rows and other columns stay."""
    spans = cut(repeated_spans(docs, id_col, text_col, window, gram), "spans")
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc")
    row = F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))
    loses = among(spans, F.col("row"))(row)
    joined = docs.where(loses).select(whole, row.alias("row")).join(spans.hint("merge"), "row", "left").select("doc", "spans")
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for b in pieces(batches):
            cols = b.column(0).flatten()
            texts = []
            for text, sp in zip(cols[at].to_pylist(), b.column(1).to_pylist(), strict=True):
                if sp:
                    words = words_of(text)
                    text = b" ".join([words[i] for i in np.flatnonzero(~_mask(len(words), sp, window))]).decode("utf-8", "surrogatepass")
                texts.append(text)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return joined.mapInArrow(run, schema).union(docs.where(~loses))
