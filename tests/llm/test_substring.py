"""Substring dedup against brute force: the sketch, clashing ids and names, odd rows."""

import collections
import hashlib
import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riverlens.llm import substring

from .test_minhash import SCHEMA, corpus


def brute_removal(rows, window=35):
    places, words = collections.Counter(), []
    for _, t, _ in rows:
        w = (t or "").encode().split()
        words.append(w)
        places.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for (i, _, _), w in zip(rows, words, strict=True):
        gone = set()
        for j in range(len(w) - window + 1):
            if places[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_removal_as_brute_force(spark):
    rng = random.Random(4)
    rows = corpus(200, 5) + [(900, " ".join(f"z{i % 40}" for i in range(300)), "x"), (901, " ".join(rng.choice("ab") for _ in range(500)), "x")]
    got = sorted(map(tuple, substring.removal(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()), key=str)
    assert got == sorted(brute_removal(rows), key=str)
    assert substring.removal(spark.createDataFrame([], SCHEMA)).count() == 0


def test_remove_repeats_keeps_rows_and_columns(spark):
    rows = corpus(60, 6)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = substring.remove_repeats(docs)
    assert got.columns == docs.columns
    texts = collections.Counter(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for r in got.collect())
    assert texts == collections.Counter(h for *_, h in brute_removal(rows))


def test_sketch_never_counts_too_low():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    parts = [rng.choice(keys, 900) for _ in range(6)]
    bits, merged = 13, np.zeros((substring.DEPTH, 1 << 13), np.uint8)
    for p in parts:
        own = np.zeros_like(merged)
        substring.count(own, p[:500])
        substring.count(own, p[500:])
        merged = np.minimum(2, merged + own)
    counts = collections.Counter(np.concatenate(parts).tolist())
    heavy = np.packbits((merged > 1).reshape(-1), bitorder="little")
    maybe = dict(zip(keys.tolist(), substring.maybe_repeated(keys, bits, heavy).tolist(), strict=True))
    assert all(maybe[k] for k, n in counts.items() if n > 1)
    once = [k for k, n in counts.items() if n == 1]
    assert sum(maybe[k] for k in once) < 0.5 * len(once)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    rows = corpus(120, 8)
    monkeypatch.setattr(substring, "SPARE", 0)  # the least width
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, substring.removal(docs).collect()), key=str)
    assert got == sorted(brute_removal(rows), key=str)


def test_unique_windows_do_not_reach_the_exact_pass(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(300)), "x") for i in range(60)]
    bits, heavy = substring.repeated_cells(spark.createDataFrame(rows, SCHEMA).repartition(4), "text", 35, 8)
    seen = [substring.maybe_repeated(substring.runs_of(substring.words_of(t), 35, 8)[0], bits, np.frombuffer(heavy, np.uint8)) for _, t, _ in rows]
    assert np.concatenate(seen).mean() < 0.1


def test_clashing_ids_and_names(spark):
    words = [" ".join(f"{p}{i}" for i in range(60)) for p in "abc"]
    rows = [(1, words[0], "x"), (1, words[1], "x"), (2, words[0], "x"), (None, words[2], "x"), (None, words[2], "x"), (3, " ".join(f"l{i}" for i in range(30000)), None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, substring.removal(docs).collect()), key=str)
    assert got == sorted(brute_removal(rows), key=str)
    odd = docs.selectExpr("1 as row", "doc_id", "'s' as spans", "text", "2 as doc", "3 as n_removed", "4 as `a.b`", "5 as _spans")
    out = substring.remove_repeats(odd)
    assert out.columns == odd.columns and sorted(len((r.text or "").split()) for r in out.collect()) == [0, 0, 0, 0, 60, 30000]
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def test_sets_of_keys_lose_none(spark, monkeypatch):
    keys, all_ = [k * 7919 - 10**12 for k in range(3000)], spark.range(20000).selectExpr("id * 7919 - 1000000000000 as k")
    table = spark.createDataFrame([(k,) for k in keys], "k long")
    found = {r.k for r in all_.where(substring.among(table, F.col("k"))("k")).collect()}
    assert found >= set(keys) and len(found) < 3000 + 0.2 * 17000
    assert all_.where(substring.among(table.limit(0), F.col("k"))("k")).count() == 0
    monkeypatch.setattr(substring, "SET_BITS", 15)  # far too few
    many = all_.where("k % 2 = 0")
    assert {r.k for r in all_.where(substring.among(many, F.col("k"))("k")).collect()} >= {r.k for r in many.collect()}


def test_texts_without_repeats_are_not_shuffled(spark):
    """Two texts that share a passage among many large ones: the shuffles hold a part of the texts' bytes."""
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(i, " ".join([shared] * (i < 2) + [f"{rng.randrange(16**12):x}" for _ in range(6000)]), "x") for i in range(60)]
    docs, sc = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint(), spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    before, got = written(), sorted(map(tuple, substring.removal(docs).collect()))
    assert got == sorted(brute_removal(rows)) and [r[2] for r in got[:3]] == [50, 50, 0]
    assert written() - before < 0.5 * sum(len(t) for _, t, _ in rows)
    cleaned = {r.doc_id: len(r.text.split()) for r in substring.remove_repeats(docs).collect()}
    assert cleaned == {i: 6000 for i in range(60)}


def test_a_stage_has_one_python_step(spark):
    """Between two Python steps stands a shuffle, else an executor has two workers for each core."""
    docs = spark.createDataFrame(corpus(60, 6), SCHEMA).repartition(4).localCheckpoint()
    for out in (substring.removal(docs), substring.remove_repeats(docs)):
        above, steps = [], 0
        for line in out._jdf.queryExecution().executedPlan().toString().splitlines():
            if m := re.search(r"[A-Z]\w+", line):
                above = [x for x in above if x[0] < m.start()] + [(m.start(), m.group())]
                names = [x for _, x in above]
                if re.search("Python|InArrow", names[-1]):
                    steps += 1
                    below = max((i for i, x in enumerate(names) if x.endswith("Exchange")), default=-1)
                    assert not [x for x in names[below + 1 : -1] if re.search("Python|InArrow", x)], names
        assert steps >= 3


def test_memory_of_a_task_does_not_grow_with_its_batch():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(4000)]
    spans, all_ = [{"start": 0, "windows": 5, "single": True}] * 20, SimpleNamespace(value=b"\xff" * 2048)

    def peak(step, n, *more):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts[:n]), *(pa.array([x] * n) for x in more)], ["a", "b", "c"][: 2 + len(more)])
        tracemalloc.start()
        rows = sum(b.num_rows for b in step([batch]))
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, size

    for step, more in ((substring._runs(all_, 13, 35, 8), ()), (substring._windows(35), (spans,))):
        peak(step, 500, *more)  # the cache of words fills
        (few, small), (many, large) = peak(step, 500, *more), peak(step, 4000, *more)
        assert many > 7 * few and large < 1.5 * small
