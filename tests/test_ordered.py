"""Operators over an order: equal to plain Python, and no window or group that holds all rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlens.operators import evaluate, ordered, series


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_as_numpy(spark):
    r = random.Random(4)
    kinds = [lambda: r.gauss(0, 1), lambda: float(r.randint(0, 3)), lambda: 0.0 if r.random() < 0.7 else r.expovariate(1), lambda: r.choice([1e-300, 1e300, -5.0])]
    rows = [(k if k < 3 else None, f()) for k, f in enumerate(kinds) for _ in range(3000)] + [(9, 2.5), (8, None), (1, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    qs = [0.0, 0.02, 0.25, 0.5, 0.95, 0.999, 1.0]
    got = {x["k"]: x["quantiles"] for x in ordered.quantiles(df, "v", qs, ["k"]).collect()}
    own = {}
    for k, v in rows:
        if v is not None:
            own.setdefault(k, []).append(v)
    assert set(got) == set(own)
    for k, vs in own.items():
        assert got[k] == pytest.approx(np.quantile(vs, qs).tolist(), rel=1e-12), k
    whole = ordered.quantiles(df, "v", qs).collect()
    assert whole[0]["quantiles"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], qs).tolist(), rel=1e-12)
    assert ordered.quantiles(df.limit(0), "v", qs).count() == ordered.quantiles(df.where("v is null"), "v", qs, ["k"]).count() == 0


def test_quantiles_keep_a_small_part_of_the_rows(spark):
    """The second pass shuffles what is in the brackets."""
    df = spark.range(200_000).select(F.rand(1).alias("v"))
    seen = []
    was = ordered.running
    ordered.running = lambda per, *a: seen.append(per.count()) or was(per, *a)
    try:
        got = ordered.quantiles(df, "v", [0.9]).first()["quantiles"][0]
    finally:
        ordered.running = was
    assert got == pytest.approx(float(np.quantile([x.v for x in df.collect()], 0.9)), rel=1e-12)
    assert seen[0] < 200_000 * 0.03


def test_no_exact_percentile_is_left_in_a_group(spark):
    d = spark.createDataFrame([(1, 0.1, "1995-07-01")] * 5, "c int, v double, d string").select("c", "v", F.col("d").cast("date").alias("date"))
    for df in (series.wet_threshold(d, (1990, 2000), "v", wet=0.0), evaluate.calibrate(d, "c", "v", 0.0)):
        assert not re.search(r"\bpercentile\(", plan(df)), plan(df)


@pytest.mark.parametrize("ranges", [3, 64])
def test_carried_across_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(ordered, "RANGES", ranges)
    r = random.Random(ranges)
    rows = [(k, float(i), r.random() if r.random() < 0.05 else None) for k in ("a", "b", None) for i in range(200) if r.random() < 0.8]
    rows += [("c", float(i), None) for i in range(20)] + [("a", 50.0, None), ("a", 50.0, None)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "k string, x double, v double")
    got = ordered.carried(df, "x", "v", "b", "a", ["k"]).collect()
    assert len(got) == len(rows)
    for g in got:
        known = [(x, v) for k, x, v in rows if k == g.k and v is not None]
        assert g.b in ([v for x, v in known if x == max(y for y, _ in known if y <= g.x)] if any(x <= g.x for x, _ in known) else [None])
        assert g.a in ([v for x, v in known if x == min(y for y, _ in known if y >= g.x)] if any(x >= g.x for x, _ in known) else [None])


def test_one_series_without_keys_runs_in_ranges(spark):
    """Interpolation over gaps that are wider than a range, in windows that never hold the whole series."""
    points = spark.createDataFrame([(0.0, 1.0), (10.0, 2.0), (990.0, 100.0)], "x double, y double")
    targets = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    out = series.interpolate(points, targets, "x", "y")
    got = {r.x: r.y for r in out.collect()}
    want = np.interp(np.arange(991.0), [0, 10, 990], [1, 2, 100])
    assert [got[float(i)] for i in range(991)] == pytest.approx(want.tolist())
    assert got[995.0] is None
    assert not re.search(r"Window \[[^\n]*windowspecdefinition\(_x", plan(out))
    dates = spark.sql("select date '2000-01-01' + cast(id as int) as date from range(400)")
    cited = spark.sql("select explode(array(date '2000-01-03', date '2000-12-30')) as date")
    basis = {str(r.date): (str(r.before), str(r.after), r.gap, r.basis) for r in series.basis_for(dates, cited).collect()}
    assert basis["2000-06-01"] == ("2000-01-03", "2000-12-30", 362, "interpolated")
    assert basis["2000-01-01"] == ("None", "2000-01-03", None, "none")


def test_numbered_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("a"), F.lit("x").alias("b"))
    for n in (1, 5):
        got = sorted((r.number, r.a) for r in ordered.numbered(df.repartition(n), ["a"]).collect())
        assert [i for i, _ in got] == list(range(1000))
        assert [a for _, a in got] == sorted(a for _, a in got)
    assert ordered.numbered(df.limit(0), ["a"]).count() == 0
