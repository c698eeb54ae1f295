import numpy as np
import pytest

from riverlens.llm import embedding


def brute(rows, least=0.93):
    by = {}
    out = {}
    for i, e, label in rows:
        ok = label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
        if ok:
            by.setdefault((label, len(e)), []).append((i, e))
        else:
            out[i] = (0, i)
    for group in by.values():
        ids = np.array([i for i, _ in group])
        x = embedding.unit([e for _, e in group])
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        order = np.argsort(ids)
        u, v = np.nonzero(near[np.ix_(order, order)])
        root = embedding._forest(len(ids), u, v)
        for k, j in enumerate(order):
            out[int(ids[j])] = (int(near[j].sum()), int(ids[order][root[k]]))
    return out


def rows(n=500, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    out = []
    for i in range(n):
        if i % 3 == 0:
            e = centres[i % 12] + rng.normal(scale=0.27, size=dim)
        elif i % 3 == 1 and i > 100:
            e = centres[3]  # one vector that a third of the rows share
        else:
            e = rng.normal(size=dim)
        out.append((i, [float(np.float32(v)) for v in e], int(i % 3 == 2)))
    odd = [None, [], [0.0] * dim, [None] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0] * 3]
    return out + [(n + k, e, 0) for k, e in enumerate(odd)] + [(n + 50, out[0][1], None), (n + 51, out[0][1], 0)]


@pytest.mark.parametrize("shard", [2048, 100])
def test_links_and_components_as_brute_force(spark, shard):
    data = rows()
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(d, shard=shard).collect()}
    assert got == brute(data)


def test_empty_table(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 24))
    x = embedding.unit(np.repeat(base, 4, axis=0) + rng.normal(scale=0.1, size=(800, 24)))
    a, b = embedding._links(x, x, embedding.Graph(x), 0.93)
    u, v = np.nonzero(x @ x.T >= 0.93)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert found <= set(zip(u.tolist(), v.tolist(), strict=True))
    assert len(found) >= 0.99 * len(u)


def test_small_labels_go_through_graphs(spark, monkeypatch):
    """Labels of a few vectors are searched in their graphs like all others."""
    asked = []
    search = embedding.Graph.range_search
    monkeypatch.setattr(embedding.Graph, "range_search", lambda self, q, least, beam: asked.append(len(self.x)) or search(self, q, least, beam))
    x = embedding.unit([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])
    a, b = embedding._links(x, x, embedding.Graph(x), 0.93)
    assert asked == [3, 3, 3] and {(0, 1), (1, 0)} <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_repeated_rows_null_ids_and_clashing_names(spark):
    near, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    data = [(1, near, "a"), (1, near, "a"), (2, [1.0, 0.0, 0.11], "a"), (None, near, "a"), (3, far, "a"), (4, near, "b")]
    d = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in data], "vec_id long, embedding array<double>, label string, n_links int, shard int, rep string, i int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in embedding.near_duplicates(d).collect())
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_recall_over_many_shards(spark):
    """Planted near copies over ten shards, each link found against brute force."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 24))
    x = np.repeat(base, 5, axis=0) + rng.normal(scale=0.12, size=(2000, 24))
    data = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label string"), shard=200).collect()}
    want = brute(data)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
