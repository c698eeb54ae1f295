"""Near-dedup against brute force, with planted copies."""

import random

from riverlens.llm import minhash
from riverlens.llm.components import components

SCHEMA = "doc_id long, text string, n_shingles string"


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            words = list(rng.choice(texts))
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.randint(1, 200))]
            if kind > 0.8:
                at = rng.randrange(len(words))
                words[at:at] = passage
        texts.append(words)
        sep = rng.choice([" ", "\n", "  ", "\t"])
        rows.append((i, sep.join(w.upper() if rng.random() < 0.1 else w for w in words), "x"))
    more = [(n, None, "x"), (n + 1, "", None), (n + 2, " \n", "x"), (n + 3, "one two", "x"), (n + 4, "ONE\ttwo", "x"), (None, rows[0][1], "x"), (n + 5, "a " * 20000, "x"), (5, rows[5][1], "x")]
    return rows + more


def brute_components(rows, k=5):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i) if i is not None else None) for i in sets}


def test_near_duplicates_as_brute_force(spark):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_buckets_in_many_blocks(spark, monkeypatch):
    """Blocks of a few documents, and leaders that join nothing: all is left to the blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 300)
    rows = corpus(120, 9)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    monkeypatch.setattr(minhash, "_alike", lambda percent: lambda batches: (b.select(["a", "b"]).slice(0, 0) for b in batches))
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def near_group(n=260, seed=12, words=120):
    """Copies of one text with few to many words changed: linked through some of them only."""
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), "x"))
    return rows


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4000)
    rows = near_group()
    kept = spark.createDataFrame(rows, SCHEMA)
    got = minhash.near_duplicates(kept).collect()
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) > 5
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_tasks_give_back_a_link_a_member_at_most():
    import numpy as np

    sets = [minhash.shingle_set(t) for _, t, _ in near_group(200, 3)]
    sig = np.array([minhash.signature(s) for s in sets])
    one = np.full(len(sets), 2)
    for band in range(minhash.BANDS):
        assert len(minhash.joins(band, one, np.arange(len(sets)), sig, sets, 75)) < len(sets)
    assert minhash.joins(0, one, np.zeros(len(sets), int), sig, sets, 75) == []


def test_members_of_a_bucket_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 200)
    members = spark.createDataFrame([(32 * j + j, i, 40) for j in (1, 2, 5) for i in range(40)], "band long, doc long, n long")
    cards = spark.createDataFrame([(i, 0, 100, b"s", "t") for i in range(40)], "rep long, th long, n_shingles long, sig binary, text string")
    none = spark.createDataFrame([], "node long, component long")
    got = minhash._mixed(members, none, cards).selectExpr("band", "size(rows) as n").collect()
    assert {r.band for r in got} == {33}  # three buckets with the same members are looked at once
    assert len(got) > 150 and max(r.n for r in got) <= 20 and sum(r.n for r in got) == 40 * 20
    joined = spark.createDataFrame([(i, 0) for i in range(40)], "node long, component long")
    assert minhash._mixed(members, joined, cards).isEmpty()


def test_odd_rows_of_near_dedup(spark):
    long = " ".join(f"v{i}" for i in range(60000))
    same = "q r s t u v w x"
    rows = [(1, "a b c d e f g", "p"), (1, same, "p"), (2, "a b c d e f g", "q"), (3, same, "q"), (4, long, "q"), (5, long + " end", "q"), (None, same, "q"), (None, same, "q")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {(1, 3): 1, (1, 4): 1, (2, 3): 1, (3, 4): 1, (4, 59996): 4, (5, 59997): 4, (None, 4): None}
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 4]
    clash = docs.selectExpr("doc_id", "text", "'x' as id", "1 as rep", "2 as band", "3 as component", "4 as th", "5 as kept")
    assert minhash.drop_near_duplicates(clash).columns == clash.columns and minhash.drop_near_duplicates(clash).count() == 4


def test_drop_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f g", "p"), (2, "A b c d e f g", "q"), (3, "other words here", None)]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
