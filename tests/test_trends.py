"""Trend tests of series of any length, and the permutation of M8, against plain forms."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlens.operators import evaluate, ordered


def plain(t, v):
    s = [int(v[j] > v[i]) - int(v[j] < v[i]) for i in range(len(t)) for j in range(len(t)) if t[i] < t[j]]
    m = [(v[j] - v[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(len(t)) if t[i] < t[j]]
    return sum(s), float(np.median(m)) if m else None


@pytest.mark.parametrize("short", [0, 1024])
def test_counts_as_all_pairs(monkeypatch, short):
    monkeypatch.setattr(evaluate, "SHORT", short)
    r = random.Random(2)
    for n in [0, 1, 2, 3, 5, 17, 64, 65, 100]:
        for kind in range(3):
            t = np.array([float(r.randint(0, n) if kind else i) for i in range(n)])
            v = np.array([float(r.randint(0, 4)) if kind == 2 else r.gauss(0, 1) for _ in range(n)])
            s, m = plain(t, v)
            assert evaluate._concordance(t, v) == s
            got = evaluate._median_slope(t, v)
            assert got == pytest.approx(m, rel=1e-9, abs=1e-12) if m is not None else got is None


def test_long_series_in_seconds():
    r = np.random.default_rng(1)
    t = np.arange(200_000.0)
    start = time.time()
    assert evaluate._concordance(t, t) == 200_000 * 199_999 // 2
    assert evaluate._median_slope(t[:20_000], 0.5 * t[:20_000] + r.normal(0, 100, 20_000)) == pytest.approx(0.5, abs=0.01)
    assert time.time() - start < 60


def test_no_row_for_a_pair(spark):
    rows = [(k, y, float((y * 7 + k) % 11)) for k in range(3) for y in range(60)] + [(9, 2000, 1.0), (8, 1, None)]
    df = spark.createDataFrame(rows, "series int, year int, v double")
    for out in (evaluate.mann_kendall(df, "year", "v"), evaluate.sens_slope(df, "year", "v")):
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[1]
    got = {x.series: x for x in evaluate.mann_kendall(df, "year", "v").collect()}
    assert set(got) == {0, 1, 2}
    for k in range(3):
        t, v = zip(*[(y, x) for s, y, x in rows if s == k], strict=True)
        assert got[k].s == plain(t, v)[0] and got[k].n == 60


def test_p_as_erfc(spark):
    zs = [0.0, 1e-9, 0.3, -1.96, 1.96, 2.5758, -5.0, 8.0, 30.0, None]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(evaluate.two_sided_p(F.col("z")).alias("p")).collect()]
    for z, p in zip(zs, got, strict=True):
        assert p is None if z is None else p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096])
def test_shuffled_is_a_bijection(spark, n):
    df = spark.range(n)
    a = {r.id: r.x for r in df.select("id", ordered.shuffled(F.col("id"), n, 5).alias("x")).collect()}
    assert sorted(a.values()) == list(range(n))
    b = {r.id: r.x for r in df.repartition(5).select("id", ordered.shuffled(F.col("id"), n, 5).alias("x")).collect()}
    assert a == b
    if n > 100:
        c = [r.x for r in df.orderBy("id").select(ordered.shuffled(F.col("id"), n, 6).alias("x")).collect()]
        d = np.array([a[i] for i in range(n)])
        assert abs(np.corrcoef(d, np.arange(n))[0, 1]) < 0.2 and abs(np.corrcoef(d, c)[0, 1]) < 0.2
