import hashlib
import random
import time
import zlib

import numpy as np

from riverlens.llm import periodic, queries


def brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def text(r):
    k, w = r.choice([1, 2, 3, 4, 30]), []
    for _ in range(r.randint(0, 8)):
        if r.random() < 0.5:
            w += [b"%d" % r.randrange(k) for _ in range(r.randint(0, 12))]
        else:
            u = [b"%d" % r.randrange(k) for _ in range(r.randint(1, 6))]
            if r.random() < 0.3:
                u = u * r.randint(1, 5) + [b"z"]
            w += (u * r.randint(2, 9))[: r.randint(1, 60)]
    return w


def test_runs_as_brute_force():
    r = random.Random(11)
    for _ in range(150):
        texts = [text(r) for _ in range(r.randint(1, 12))]
        assert periodic.runs_of(texts) == [brute(t) for t in texts]


def test_small_blocks_of_tries(monkeypatch):
    monkeypatch.setattr(periodic, "TRIED", 7)
    r = random.Random(3)
    texts = [text(r) for _ in range(20)]
    assert periodic.runs_of(texts) == [brute(t) for t in texts]


def test_grammar_gives_the_text_back():
    """Occurrences nest, rules have one expansion, and no pair of the symbols left over occurs twice."""
    r = np.random.default_rng(2)
    sym = np.r_[r.integers(0, 5, 300), np.tile(r.integers(0, 50, 40), 6)]
    rule, start, mid, end, top = periodic.repair(sym)
    body = {}
    for x, a, m, b in zip(rule.tolist(), start.tolist(), mid.tolist(), end.tolist(), strict=True):
        assert a < m < b
        assert body.setdefault(x, (m - a, sym[a:b].tolist())) == (m - a, sym[a:b].tolist())
    parts = [tuple(sym[a:b].tolist()) for a, b in zip(top, [*top[1:], len(sym)], strict=True)]
    assert [x for p in parts for x in p] == sym.tolist()
    assert len(parts) < len(sym) / 2


def test_long_periodic_texts_in_seconds():
    start = time.time()
    assert periodic.runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    assert periodic.runs_of([[b"a", b"b", b"c"] * 50_000 + [b"x", b"y"] * 50_000]) == [[(0, 150_000, 3), (150_000, 100_000, 2)]]
    assert len(periodic.runs_of([([b"a"] * 300 + [b"b"]) * 300])[0]) == 301
    assert time.time() - start < 30


def test_runs_stay_in_their_text():
    assert periodic.runs_of([[b"a"] * 4, [b"a"] * 4, [b"a"] * 6]) == [[], [], [(0, 6, 1)]]


def looped_words(i, words):
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (j - a) % p] for j in range(a, n)]


def test_query_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w = looped_words(d.doc_id, (d.text or "").encode().split())
        if len(w) > 1500:
            continue
        runs = brute(w)
        some += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        assert got[d.doc_id] == want, d.doc_id
    assert some > 5


def test_defined_cases(spark):
    schema = "start int, doc_id long, text string, period string"
    rows = [(1, 1, None, "x"), (1, 2, "", "x"), (1, 3, "a b " * 4, "x"), (2, 3, "a b " * 4, None), (1, None, "no run here", "x"), (1, 7, " \t ", "x")]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, periodic.runs(docs).collect())) == [(3, 0, 8, 2)] * 2
    assert sorted(map(repr, map(tuple, periodic.collapse(docs).collect()))) == sorted(map(repr, [(1, 0, ""), (2, 0, ""), (3, 1, "a b"), (3, 1, "a b"), (None, 0, "no run here"), (7, 0, "")]))
    out = periodic.digest(periodic.looped(docs)).collect()
    assert len(out) == 6 and all(len(r.runs_sha256) == 64 and len(r.collapsed_sha256) == 64 for r in out)
    empty = spark.createDataFrame([], schema)
    assert periodic.runs(empty).count() == periodic.collapse(empty).count() == periodic.digest(periodic.looped(empty)).count() == 0
