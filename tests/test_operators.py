"""Hand-computed cases of single operators, error cases and plan shapes."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riverlens.functions import calendar as K
from riverlens.functions import scalars as P
from riverlens.operators import evaluate as E
from riverlens.operators import series as S
from riverlens.operators import spatial as N
from riverlens.operators import zonal as Z
from riverlens.sources import tables


def days(*rows):
    return [(p, dt.date(2025, 1, 1) + dt.timedelta(d), w) for p, d, w in rows]


@pytest.mark.parametrize(
    ("passes", "observed", "span"),
    [([(0, True), (1, True), (3, True)], 4, 4), ([(0, True), (1, False), (3, True)], 2, 4), ([(0, True), (10, True)], 2, 11), ([(0, False)], 0, 0)],
)
def test_durations(spark, passes, observed, span):
    px = spark.createDataFrame(days(*((1, d, w) for d, w in passes)), "pixel long, day date, wet boolean")
    assert Z.days_observed_wet(px).first().days == observed
    assert Z.span_duration(px).first().span == span


def test_windows_are_half_open_and_the_last_is_short(spark):
    w = K.season_windows(spark, [2025]).orderBy("idx").collect()
    assert len(w) == 11
    assert (w[0].window_start, w[0].window_end) == (dt.date(2025, 6, 15), dt.date(2025, 6, 25))
    assert (w[-1].window_start, w[-1].window_end) == (dt.date(2025, 9, 23), dt.date(2025, 9, 30))
    d = spark.createDataFrame([(dt.date(2025, 6, 25),), (dt.date(2025, 9, 30),), (dt.date(2025, 6, 14),)], "day date")
    assert [r.window_start for r in K.assign_window(d, "day").collect()] == [dt.date(2025, 6, 25), None, None]
    i = spark.createDataFrame([(dt.date(2025, 6, 20), dt.date(2025, 7, 2), "x")], "start date, end date, label string")
    assert [r.label for r in K.assign_interval(d, "day", i).orderBy("day").collect()] == [None, "x", None]


def test_rain_sums(spark):
    daily = spark.createDataFrame([(dt.date(2025, 6, 15) + dt.timedelta(i), 1.0) for i in range(20)], "date date, mm double")
    w = K.season_windows(spark, [2025])
    got = {r.window_start: (r.mm, r.days) for r in S.window_sum(daily, w, "mm").collect()}
    assert got[dt.date(2025, 6, 15)] == (10.0, 10)
    assert got[dt.date(2025, 7, 5)] == (None, 0)
    lag = {r.window_start: r.mm_lag1 for r in S.window_with_lags(daily, w, "mm").collect()}
    assert lag[dt.date(2025, 7, 5)] == 10.0


def test_change_rule_and_nodata(spark):
    rows = [(-18.0, -10.0, True), (-14.0, -10.0, False), (-18.0, -16.0, False), (-18.0, -15.0, False), (None, -10.0, False), (-18.1, -15.0, True)]
    d = spark.createDataFrame(rows, "post double, pre double, want boolean")
    assert d.where(P.tier_a("post", "pre") != F.col("want")).count() == 0
    assert spark.range(1).select(P.to_db(F.lit(None).cast("double")).alias("v")).first().v is None


def test_errors_are_raised(spark):
    one = spark.range(1)
    for c in (P.to_ha(F.lit(1.0), F.lit("acre")), P.to_ha(F.lit(-1.0), F.lit("ha")), K.period_year(F.lit("long ago"))):
        with pytest.raises(PySparkException):
            one.select(c.alias("v")).collect()
    with pytest.raises(ValueError, match="missing columns: b"):
        tables.require(one.withColumnRenamed("id", "a"), ["a", "b"])


def test_zone_without_area_is_zero(spark):
    c = E.agreement_metrics(E.confusion(spark.createDataFrame([], "p boolean, r boolean"), "p", "r"))
    assert c.first().iou == 0.0
    none = E.agreement_metrics(E.confusion(spark.createDataFrame([], "p boolean, r boolean"), "p", "r"), None)
    assert none.first().iou is None


def test_mann_kendall_and_slope(spark):
    s = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", i, 1.0) for i in range(10)], "series string, t int, v double")
    m = {r.series: r for r in E.mann_kendall(s, "t", "v").collect()}
    assert (m["a"].s, round(m["a"].tau, 6)) == (45.0, 1.0)
    assert m["a"].p == pytest.approx(math.erfc(44 / math.sqrt(125) / math.sqrt(2)))
    assert (m["b"].s, m["b"].z, m["b"].p) == (0.0, 0.0, 1.0)
    assert {r.series: r.slope for r in E.sens_slope(s, "t", "v").collect()} == {"a": 1.0, "b": 0.0}


def test_spearman(spark):
    d = spark.createDataFrame([(1.0, 4.0, 1.0), (2.0, 3.0, 1.0), (3.0, 2.0, 1.0), (4.0, 1.0, 1.0)], "a double, b double, c double")
    assert E.spearman(d, "a", "b").first().rho == pytest.approx(-1)
    assert E.spearman(d, "a", "c").first().rho is None


def test_conformal_radius(spark):
    d = spark.createDataFrame([(float(i),) for i in range(1, 10)], "residual double")
    assert E.conformal_quantile(d, "residual", 0.9).first().radius == 9.0
    assert E.conformal_quantile(d, "residual", 0.95).first().radius == float("inf")


def test_sieve_keeps_parts_of_n_pixels(spark):
    cells = [(0, 0), (0, 1), (0, 2), (5, 5), (6, 6), (9, 0)]
    m = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(cells)], "pixel long, row long, col long")
    assert sorted(r.pixel for r in N.sieve(m, 3).collect()) == [0, 1, 2]
    assert sorted(r.pixel for r in N.sieve(m, 2, 8).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.pixel for r in N.sieve(m, 2, 4).collect()) == [0, 1, 2]
    line = spark.createDataFrame([(i, 0, i) for i in range(70)], "pixel long, row long, col long")
    assert {r.label for r in N.connected_labels(line).collect()} == {0}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pass_scan_prunes_partitions(spark, tmp_path):
    px = spark.createDataFrame(days((1, 0, True), (1, 5, False)), "pixel long, day date, wet boolean").withColumn("season", F.year("day"))
    px.write.partitionBy("season", "day").parquet(str(tmp_path / "px"))
    d = tables.read_pass_masks(spark, str(tmp_path / "px"), "2025-01-01", "2025-01-03")
    assert d.count() == 1
    assert "PartitionFilters: [isnotnull(day" in plan(d)


def test_no_nested_loops_in_range_joins(spark):
    daily = spark.createDataFrame([(dt.date(2025, 6, 15), 1.0)], "date date, mm double")
    w = K.season_windows(spark, [2025])
    for d in (S.window_with_lags(daily, w, "mm"), S.window_sum(daily, w, "mm"), S.interpolate(daily, daily.select("date"), "date", "mm")):
        assert "NestedLoop" not in plan(d) and "Cartesian" not in plan(d)


def test_running_totals_as_brute_force(spark):
    import random

    from riverlens.operators.ordered import running

    rng = random.Random(2)
    rows = {(rng.choice("ab"), round(rng.gauss(0, 1), 2)): rng.randint(1, 9) for _ in range(600)}
    d = spark.createDataFrame([(k, v, n) for (k, v), n in rows.items()], "k string, v double, n long")
    for keys in ((), ("k",)):
        one = d if keys else d.groupBy("v").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
        got = {(r.v, r.k if keys else None): r.below_n for r in running(one, "v", ["n"], keys).collect()}
        for (v, k), below in got.items():
            assert below == sum(n for (g, w), n in rows.items() if w < v and (not keys or g == k))
    assert running(d.limit(0), "v", ["n"]).count() == 0


def test_no_window_holds_all_rows(spark):
    """Ranks, curves and radii: no nested loop over rows and no exchange to a single partition of them."""
    d = spark.range(200).selectExpr("id % 7 as y7", "cast(id % 2 as int) as y", "id / 200 as prob", "id / 190 as truth", "id / 180 as pred", "cast(2000 + id % 5 as int) as year")
    for df in (E.average_rank(d, "prob", "r"), E.conformal_quantile(d.withColumn("residual", d.prob), "residual", 0.9, ("year",)), E.classification_metrics(d, keys=("year",))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
        windows = [x for x in plan.splitlines() if "Window [" in x]
        assert all("_run_" in x for x in windows)


def test_a_source_that_breaks_while_it_is_read_is_degraded(spark):
    from pyspark.sql import functions as F

    from riverlens.streaming.monitor import publish_or_degrade

    bad = publish_or_degrade(spark, lambda: spark.range(3).select(F.raise_error(F.lit("broken tile")).cast("long").alias("n")), "n long").collect()
    assert len(bad) == 1 and bad[0].n is None and "broken tile" in bad[0].degraded
    good = publish_or_degrade(spark, lambda: spark.range(3).select(F.col("id").alias("n")), "n long").collect()
    assert sorted((r.n, r.degraded) for r in good) == [(0, None), (1, None), (2, None)]


def test_last_days_are_written_anew(spark, tmp_path):
    import datetime

    from riverlens.streaming.monitor import rewrite_last_days

    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(k)
    path, schema = str(tmp_path / "t"), "day date, v int"
    spark.createDataFrame([(day(k), 1) for k in range(20)], schema).write.partitionBy("day").parquet(path)
    rewrite_last_days(spark.createDataFrame([(day(k), 2) for k in range(20)], schema), path, 5)
    got = {r.day: r.v for r in spark.read.parquet(path).collect()}
    assert got == {day(k): 2 if k >= 15 else 1 for k in range(20)}


def test_features_and_variants():
    import pytest

    from riverlens.operators import forecast as M

    assert len(M.FEATURE_ORDER) == 16 and M.variant_features("full") == M.FEATURE_ORDER
    assert M.FEATURE_ORDER[:6] == M.RAIN and M.FEATURE_ORDER[6:12] == M.RESERVOIRS and M.FEATURE_ORDER[12:] == ("antecedent", "week", *M.PRIORS)
    assert len(M.variant_features("no_reservoir")) == 10 and not set(M.variant_features("no_reservoir")) & set(M.RESERVOIRS)
    assert len(M.variant_features("meteo_prior")) == 9 and "antecedent" not in M.variant_features("meteo_prior")
    for name in ("persistence", "no such"):
        with pytest.raises(ValueError, match="no variant"):
            M.variant_features(name)


def test_live_features_keep_order_and_missing_values(spark):
    from riverlens.operators import forecast as M

    zones = spark.createDataFrame([("a",), ("b",)], "zone string")
    scalars = spark.range(1).selectExpr("4 as week", *(f"{i}d as {c}" for i, c in enumerate(M.RAIN)), *(f"cast(null as double) as {c}" for c in M.RESERVOIRS))
    ante = spark.createDataFrame([("a", 0.03)], "zone string, antecedent double")
    prior = spark.createDataFrame([("a", 2808.25, 3), ("b", 4338.24, 2)], "zone string, prior_mean_ha double, prior_seasons_2pct long")
    f = M.live_features(zones, scalars, ante, prior)
    assert f.columns == ["zone", *M.FEATURE_ORDER]
    got = {r.zone: r for r in f.collect()}
    assert got["a"].antecedent == 0.03 and got["b"].antecedent is None and got["b"].prior_mean_ha == 4338.24
    assert all(got[z].week == 4 and got[z].dam1_storage is None and got[z].upstream_mm == 1.0 for z in "ab")
