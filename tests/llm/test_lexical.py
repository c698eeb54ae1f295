import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from riverlens.llm import lexical, queries

from .. import oracle

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_all, l_all = len(own), sum(len(t) for _, t in own)
    df = Counter(w for _, t in own for w in set(t))
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(terms(t))
    out = []
    for item, ws in by_item.items():
        scored = []
        for i, t in own:
            tf, m = Counter(t), 50 + 50 * len(t) * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * m)) for w in ws if w in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_query_as_sql(spark):
    assert oracle.difference(spark, oracle.connect(SF), queries.op11_lexical_search, lexical.ORACLE_SQL, SF) is None


@pytest.mark.parametrize("seed", range(3))
def test_random_tables_as_brute_force(spark, monkeypatch, seed):
    """Several trees a task, several blocks of items, searches that begin with a few documents; many
    repeated documents and equal scores."""
    monkeypatch.setattr(lexical, "TREE_ENTRIES", 60)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 12)
    monkeypatch.setattr(lexical, "AHEAD", 20)
    r = random.Random(seed)
    words = ["a", "B", "b", "ç", "漢字", "x1", "y", "zz", "Q"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(120)]
    docs += [(200 + i % 7, "a b zz") for i in range(30)] + [(None, "zz a"), (None, None), (900, "")]
    items = [(i, " ".join(r.choice(words + ["absent"]) for _ in range(r.randint(0, 6)))) for i in range(12)] + [(3, "y"), (None, "zz b"), (50, None)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 7)


def test_branches_are_left_out():
    """The tree is searched with fewer scores than it has documents, and gives the same."""
    r = np.random.default_rng(0)
    docs, size = [], 60
    for i in range(4000):
        t = np.unique(r.geometric(0.08, 12) % size)
        docs.append((i, int(r.integers(50, 200)), t, r.integers(1, 4, len(t)).astype(np.int64)))
    weight = np.linspace(100, 6000, size).astype(np.int64)
    root = lexical.build(docs, size)
    items = [np.array([3, 50, 57]), np.array([10, 40])]
    best = lexical.Best(items, 5, np.ones(2))
    asked, bounds = [], best.bounds
    best.bounds = lambda gain, active: asked.append(len(active)) or bounds(gain, active)
    best.search(root, weight)
    for j, ts in enumerate(items):
        want = sorted(((int(sum(weight[t] * (10**9 * f // (1000 * f + 20 * m)) for t, f in zip(x, y) if t in ts)), -i) for i, m, x, y in docs), reverse=True)[:5]
        assert sorted(best.kept[j], reverse=True) == want
    assert len(asked) < len(docs) / 2


def test_defined_cases(spark):
    docs = spark.createDataFrame([("s", 1, None, 5), ("s", 2, "Sun sun", 5), ("s", 2, "Sun sun", 6)], "score string, doc_id long, text string, rank int")
    items = spark.createDataFrame([(1, "sun", "q"), (2, "...", "q"), (3, None, "q")], "item_id long, text string, doc_id string")
    assert [tuple(r)[:3] for r in lexical.search(docs, items).orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 2)]
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("text is null"), items).count() == 0
