"""Statistics and scores: trends, agreement, rank correlation, classification, conformal intervals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverlens.operators.ordered import quantiles, running
from riverlens.operators.series import lag1_autocorr, prewhiten, risk_rank
from riverlens.session import ship


def _concordance(t: np.ndarray, v: np.ndarray) -> int:
    """The sum of sign(v2 - v1) over all pairs t1 < t2, by merging halves: at each size the right blocks'
    values are looked up in the sorted left ones."""
    order = np.lexsort((v, t))
    rank = np.unique(v[order], return_inverse=True)[1].astype(np.int64)
    time = np.unique(t[order], return_inverse=True)[1].astype(np.int64)
    n, total, size = len(rank), 0, 1
    span, place = n + 1, np.arange(n)
    while size < n:
        block = place // size
        left, right = block % 2 == 0, block % 2 == 1
        keys = np.sort((block[left] // 2) * span + rank[left])
        of, asked = block[right] // 2, (block[right] // 2) * span + rank[right]
        first = of * size  # left blocks before a right one are whole
        below, upto = np.searchsorted(keys, asked, "left") - first, np.searchsorted(keys, asked, "right") - first
        total += int((below - (size - upto)).sum())
        size *= 2
    # pairs of one time stand in ascending order of value there, and don't count
    both = np.unique(time * span + rank, return_counts=True)[1]
    same = np.bincount(time) if n else np.zeros(1, np.int64)
    return total - (int((same * (same - 1) // 2).sum()) - int((both * (both - 1) // 2).sum()))


def _pairs(t: np.ndarray) -> int:
    same = np.unique(t, return_counts=True)[1]
    return len(t) * (len(t) - 1) // 2 - int((same * (same - 1) // 2).sum())


#: Points of a series whose slopes are all worked out at once, and steps by which others are narrowed down.
SHORT, HALVINGS = 1024, 200


def _median_slope(t: np.ndarray, v: np.ndarray) -> float | None:
    """The median of (v2 - v1) / (t2 - t1) over all pairs t1 < t2. Of a long series the slope below
    which half of the pairs lie is narrowed down by counting: a pair lies below s just if v - s t
    descends, and descents are counted by merging."""
    pairs = _pairs(t)
    if not pairs:
        return None
    if len(t) <= SHORT:
        i, j = np.triu_indices(len(t), 1)
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        later = t[j] > t[i]
        return float(np.median((v[j] - v[i])[later] / (t[j] - t[i])[later]))

    def at_most(s: float) -> int:
        """Pairs with a slope of at most s, but for those that rounding can't tell from s."""
        u = v - s * t
        ties = np.unique(u, return_counts=True)[1]
        same = int((ties * (ties - 1) // 2).sum())
        return (pairs - _concordance(t, u) + same) // 2

    r = np.random.default_rng(7)
    i, j = r.integers(0, len(t), 20_000), r.integers(0, len(t), 20_000)
    i, j = i[t[i] != t[j]], j[t[i] != t[j]]
    some = np.sort((v[j] - v[i]) / (t[j] - t[i]))

    def ranked(k: int) -> float:
        lo, hi = float(some[int(0.48 * len(some))]), float(some[int(0.52 * len(some))])
        step = max(hi - lo, abs(hi), 1e-9)
        while at_most(lo) > k:
            lo, step = lo - step, 2 * step
        while at_most(hi) <= k:
            hi, step = hi + step, 2 * step
        for _ in range(HALVINGS):
            mid = (lo + hi) / 2
            if mid in (lo, hi) or hi - lo <= 1e-15 * max(abs(lo), abs(hi)):
                break
            lo, hi = (mid, hi) if at_most(mid) <= k else (lo, mid)
        return hi

    a = ranked((pairs - 1) // 2)
    return a if pairs % 2 else (a + ranked(pairs // 2)) / 2


def _by_series(series: DataFrame, t: str, v: str, keys, name: str, kind: str, work) -> DataFrame:
    """keys and work(times, values) of each series' points that have both; series without a pair are
    left out. A series is one group: its points are two arrays of numbers."""
    ship(series.sparkSession)
    d = series.select(*keys, F.col(t).cast("double").alias("_t"), F.col(v).cast("double").alias("_v"))
    schema = d.select(*keys).schema.add(name, kind)

    def run(table: pa.Table) -> pa.Table:
        times, values = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_t", "_v"))
        ok = ~(np.isnan(times) | np.isnan(values))
        found = work(times[ok], values[ok]) if _pairs(times[ok]) else None
        out = table.select(list(keys)).slice(0, 1 if found is not None else 0)
        return out.append_column(name, pa.array([found] * len(out), pa.int64() if kind == "long" else pa.float64()))

    return d.groupBy(*keys).applyInArrow(run, schema)


def two_sided_p(z: Column) -> Column:
    """Both tails of the normal distribution. erf(x) is exp(-x^2) times the sum of x^(2n+1) / gamma(n + 3/2),
    whose terms are all positive; past |z| = 12 nothing is left."""
    x = F.least(F.abs(z), F.lit(12.0)) / math.sqrt(2)
    first = x * (2 / math.sqrt(math.pi))  # gamma(3/2) is sqrt(pi) / 2
    sums = F.aggregate(F.sequence(F.lit(1), F.lit(300)), F.array(first, first), lambda s, n: F.transform(F.array(s[1] * x * x / (n + 0.5)), lambda y: F.array(s[0] + y, y))[0])
    return F.when(z.isNotNull(), F.greatest(F.lit(0.0), 1 - F.exp(-x * x) * sums[0]))


def mann_kendall(series: DataFrame, t: str, v: str, keys=("series",)) -> DataFrame:
    """E1. S, tie-corrected variance, continuity-corrected z, p and tau-b per series. S is counted by
    merging, in n log^2 n steps of a series of n points."""
    s = _by_series(series, t, v, keys, "s", "long", _concordance).withColumn("s", F.col("s").cast("double"))
    ties = series.groupBy(*keys, v).agg(F.count("*").alias("k")).groupBy(*keys).agg(
        F.sum("k").alias("n"), F.sum(F.expr("k * (k - 1) * (2 * k + 5)")).alias("t5"), F.sum(F.expr("k * (k - 1) / 2")).alias("t0")
    )
    j = s.join(ties, list(keys))
    var = F.expr("(n * (n - 1) * (2 * n + 5) - t5) / 18d")
    z = F.when(F.col("var_s") <= 0, 0.0).when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var_s")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var_s")).otherwise(0.0)
    n0 = F.expr("n * (n - 1) / 2d")
    out = j.withColumn("var_s", var).withColumn("z", z).withColumn("tau", F.try_divide("s", F.sqrt((n0 - F.col("t0")) * n0)))
    return out.select(*keys, "n", "s", "var_s", "z", two_sided_p(F.col("z")).alias("p"), "tau")


def trend_table(series: DataFrame, t: str, v: str, keys=("series",), alpha: float = 0.05) -> DataFrame:
    """E2. The test on the series, or on the pre-whitened one where r1 is significant; the slope is the
    series' own."""
    r = lag1_autocorr(series, t, v, keys)
    r = r.withColumn("whitened", F.abs("r1") > 1.96 / F.sqrt("n")).select(*keys, "r1", "whitened")
    one = mann_kendall(series, t, v, keys).withColumn("whitened", F.lit(False))
    two = mann_kendall(prewhiten(series, t, v, keys), t, v, keys).withColumn("whitened", F.lit(True))
    j = r.join(one.unionByName(two), [*keys, "whitened"]).join(sens_slope(series, t, v, keys), list(keys))
    verdict = F.when(F.col("p") >= alpha, "no trend").when(F.col("z") > 0, "increasing").otherwise("decreasing")
    return j.withColumn("verdict", verdict)


def sens_slope(series: DataFrame, t: str, v: str, keys=("series",)) -> DataFrame:
    """E3. Median of all pairwise slopes."""
    return _by_series(series, t, v, keys, "slope", "double", _median_slope)


def return_period(series: DataFrame, t: str, v: str, target) -> DataFrame:
    """E4. Rank of the target year's value, Weibull return period (n + 1) / rank, exceedance."""
    hit = series.where(F.col(t) == target).select(F.col(v).alias("value"))
    j = series.crossJoin(F.broadcast(hit)).agg(F.count("*").alias("n"), (F.count_if(F.col(v) > F.col("value")) + 1).alias("rank"))
    return j.withColumn("return_period", (F.col("n") + 1) / F.col("rank")).withColumn("exceedance", F.col("rank") / (F.col("n") + 1))


def anomaly(series: DataFrame, t: str, v: str, target) -> DataFrame:
    """E5. A target against the years before it."""
    hit = series.where(F.col(t) == target).select(F.col(v).alias("value"))
    j = series.where(F.col(t) < target).crossJoin(F.broadcast(hit)).groupBy("value").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), (100 * F.count_if(F.col(v) <= F.col("value")) / F.count("*")).alias("percentile"),
        (F.count_if(F.col(v) > F.col("value")) + 1).alias("rank"), F.max(v).alias("max"),
    )
    return j.withColumn("z", F.try_divide(F.col("value") - F.col("mean"), F.col("std"))).withColumn("ratio", F.try_divide("value", "mean"))


def confusion(df: DataFrame, pred: str, ref: str, valid: str | None = None, keys=()) -> DataFrame:
    """E6. tp, fp, fn, tn over valid rows in which both are known."""
    p, r = F.col(pred), F.col(ref)
    ok = p.isNotNull() & r.isNotNull() & (F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True))
    cell = lambda c: F.count_if(ok & c)
    g = df.groupBy(*keys) if keys else df
    return g.agg(cell(p & r).alias("tp"), cell(p & ~r).alias("fp"), cell(~p & r).alias("fn"), cell(~p & ~r).alias("tn"))


def agreement_metrics(conf: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """E7. Empty denominators give `empty` (0.0, or None for NULL)."""

    def ratio(a: str, b: str) -> Column:
        r = F.try_divide(F.expr(a).cast("double"), F.expr(b))
        return r if empty is None else F.coalesce(r, F.lit(empty))

    made = {
        "accuracy": ("tp + tn", "tp + fp + fn + tn"), "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"),
        "f1": ("2 * tp", "2 * tp + fp + fn"), "iou": ("tp", "tp + fp + fn"), "dice": ("2 * tp", "2 * tp + fp + fn"),
    }
    return conf.withColumns({k: ratio(*v) for k, v in made.items()})


def zone_agreement(px: DataFrame, a: str, b: str, valid: str, key: str = "zone") -> DataFrame:
    """E8."""
    c = agreement_metrics(confusion(px, a, b, valid, (key,)))
    n = F.expr("tp + fp + fn + tn")
    return c.withColumns({"fraction_a": F.coalesce(F.try_divide(F.expr("tp + fp"), n), F.lit(0.0)), "fraction_b": F.coalesce(F.try_divide(F.expr("tp + fn"), n), F.lit(0.0))})


def unpivoted(df: DataFrame, masks: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, *masks).unpivot(list(keep), masks, "mask", "pred")


def score_masks(points: DataFrame, masks: list[str], truth: str = "truth", valid: str = "valid") -> DataFrame:
    """E9. Metrics per mask (NULL on empty) and the share of truth that the mask has lost."""
    c = confusion(unpivoted(points, masks, truth, valid), "pred", truth, valid, ("mask",))
    return agreement_metrics(c, None).withColumn("recession", F.try_divide("fn", F.expr("tp + fn")))


def method_benchmark(px: DataFrame, masks: list[str], ref: str, pixel_ha: float = 1.0) -> DataFrame:
    """E18."""
    c = confusion(unpivoted(px, masks, ref), "pred", ref, None, ("mask",))
    return agreement_metrics(c).withColumn("area_ha", F.expr("tp + fp") * pixel_ha)


def average_rank(df: DataFrame, c: str, out: str) -> DataFrame:
    """Ranks with ties averaged, from the counts of distinct values: those below, and (n + 1) / 2."""
    counts = running(df.groupBy(c).agg(F.count("*").alias("n")), c, ["n"])
    rank = counts.select(F.col(c).alias("_v"), (F.col("below_n") + (F.col("n") + 1) / 2).alias(out))
    return df.join(rank, F.col(c) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """E10. Over rows with both; NULL when one is constant. Also the mean absolute difference."""
    d = average_rank(average_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    rho = F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb"))  # corr() raises on a constant
    return d.agg(rho.alias("rho"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.count("*").alias("n"))


def official_compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """E11. On merged zones: correlation over the zones that the survey names, and over all with
    zero for the rest."""
    from riverlens.functions.scalars import merged_zone

    a = ours.groupBy(merged_zone("zone").alias("zone")).agg(F.sum("ours").alias("ours"))
    b = theirs.where("theirs is not null").groupBy(merged_zone("zone").alias("zone")).agg(F.sum("theirs").alias("theirs"))
    j = a.join(b, "zone", "left")
    named = spearman(j, "ours", "theirs").select(F.lit("named").alias("variant"), "rho", "n")
    return named.union(spearman(j.withColumn("theirs", F.coalesce("theirs", F.lit(0.0))), "ours", "theirs").select(F.lit("all"), "rho", "n"))


def classification_metrics(df: DataFrame, y: str = "y", p: str = "prob", keys=(), threshold: float = 0.5) -> DataFrame:
    """E12. ROC-AUC by average ranks, PR-AUC as the step sum over distinct scores, F1, precision,
    recall at a threshold, base rate; AUCs are NULL with one class. Scores are summed up first, and
    running totals are taken over the distinct ones."""
    g = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    whole = g.groupBy(*keys).agg(F.sum("pos").alias("allpos"), F.sum("n").alias("alln")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "allpos", "alln")
    below = running(g, "_p", ["pos", "n"], keys)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    g = below.join(whole, same) if keys else below.crossJoin(F.broadcast(whole))  # one row
    g = g.withColumns({"below": F.col("below_n"), "cpos": F.col("allpos") - F.col("below_pos"), "cn": F.col("alln") - F.col("below_n")})
    ranks = F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2))
    P, N = F.max("allpos"), F.max("alln")
    hot = F.col("_p") >= threshold
    tp, pp = F.sum(F.when(hot, F.col("pos")).otherwise(0)), F.sum(F.when(hot, F.col("n")).otherwise(0))
    one = (P == 0) | (P == N)
    return (g.groupBy(*keys) if keys else g).agg(
        F.when(~one, F.try_divide(ranks - P * (P + 1) / 2, P * (N - P))).alias("roc_auc"),
        F.when(~one, F.sum(F.try_divide(F.col("pos") * F.col("cpos"), F.col("allpos") * F.col("cn")))).alias("pr_auc"),
        F.coalesce(F.try_divide(2 * tp, pp + P), F.lit(0.0)).alias("f1"), F.coalesce(F.try_divide(tp, pp), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, P), F.lit(0.0)).alias("recall"),
        (P / N).alias("base_rate"), N.alias("n"),
    )


def metrics_by_year(oof: DataFrame) -> DataFrame:
    """A25. Per year and pooled in one result: counts, base rate, mean absolute and squared error."""
    g = oof.rollup("year").agg(
        F.count("*").alias("n"), F.sum("y").alias("events"), F.avg("y").alias("base_rate"), F.avg(F.abs(F.col("truth") - F.col("pred"))).alias("mae"), F.avg(F.pow(F.col("y") - F.col("prob"), 2)).alias("brier")
    )
    return g.withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("POOLED")))


def side_by_side(a: DataFrame, b: DataFrame, key: str, *metrics: str) -> DataFrame:
    """J14."""
    j = a.select(key, *(F.col(m).alias(f"{m}_a") for m in metrics)).join(b.select(key, *(F.col(m).alias(f"{m}_b") for m in metrics)), key, "full")
    return j.withColumns({f"{m}_delta": F.col(f"{m}_b") - F.col(f"{m}_a") for m in metrics})


def conformal_quantile(df: DataFrame, residual: str, level: float, keys=()) -> DataFrame:
    """E13. The ceil((n + 1) level)-th smallest residual, infinite when there are too few."""
    g = df.where(F.col(residual).isNotNull()).groupBy(*keys, F.col(residual).cast("double").alias("_r")).agg(F.count("*").alias("m"))
    n = g.groupBy(*keys).agg(F.sum("m").alias("n")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "n")
    below = running(g, "_r", ["m"], keys)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    d = below.join(n, same) if keys else below.crossJoin(F.broadcast(n))  # one row
    reached = F.col("below_m") + F.col("m") >= F.ceil((F.col("n") + 1) * level - 1e-9)
    return (d.groupBy(*keys) if keys else d).agg(F.coalesce(F.min(F.when(reached, F.col("_r"))), F.lit(float("inf"))).alias("radius"), F.max("n").alias("n"))


def loyo_conformal(df: DataFrame, levels: list[float]) -> DataFrame:
    """E14. For each year, the radius from all other years' residuals; intervals clamped to 0 .. 1 and
    their coverage. The others' counts are all counts less the year's own, so each residual is
    counted once; the driver holds the years and a radius for each."""
    years = [r.year for r in df.select("year").distinct().orderBy("year").collect()]
    r = df.select("year", F.abs(F.col("truth") - F.col("pred")).cast("double").alias("r")).where("r is not null")
    of = [f"n{i}" for i in range(len(years))]
    g = r.groupBy("r").agg(F.count("*").alias("n"), *(F.count_if(F.col("year").eqNullSafe(F.lit(y))).alias(c) for c, y in zip(of, years, strict=True)))
    whole = g.agg(*(F.sum(c).alias(f"all_{c}") for c in ["n", *of]))
    d = running(g, "r", ["n", *of]).crossJoin(F.broadcast(whole))  # one row
    pick = []
    for c, y in zip(of, years, strict=True):
        others = F.col("below_n") + F.col("n") - F.col(f"below_{c}") - F.col(c)
        for level in levels:
            reached = others >= F.ceil((F.col("all_n") - F.col(f"all_{c}") + 1) * level - 1e-9)
            pick.append(F.struct(F.lit(y).alias("year"), F.lit(level).alias("level"), F.coalesce(F.min(F.when(reached, F.col("r"))), F.lit(float("inf"))).alias("radius")))
    q = d.agg(F.array(*pick).alias("q")).select(F.inline("q")) if pick else df.sparkSession.createDataFrame([], "year int, level double, radius double")
    j = df.join(F.broadcast(q), "year")  # a row for each year and level
    lo, hi = F.greatest(F.lit(0.0), F.col("pred") - F.col("radius")), F.least(F.lit(1.0), F.col("pred") + F.col("radius"))
    g = j.withColumn("inside", F.col("truth").between(lo, hi)).groupBy("year", "level")
    return g.agg(F.max("radius").alias("radius"), F.avg(F.col("inside").cast("int")).alias("coverage"), F.avg(hi - lo).alias("width")).select("year", "radius", "coverage", "width", "level")


def flag_sheet(scores: DataFrame, top: int = 5, least: float = 0.2, keys=()) -> DataFrame:
    """E15. Best rank and probability of each zone (and year, with keys), its first window within the
    top, and the flag."""
    r = risk_rank(scores)
    g = r.groupBy(*keys, "zone").agg(F.min("risk_rank").alias("best_rank"), F.max("prob").alias("best_prob"), F.min(F.when(F.col("risk_rank") <= top, F.col("window_start"))).alias("first_window"))
    return g.withColumn("flagged", (F.col("best_rank") <= top) & (F.col("best_prob") >= least))


def ablation_table(runs: DataFrame, full: str = "full") -> DataFrame:
    """E16. runs(variant, y, prob): pooled metrics and their difference to the full variant."""
    m = classification_metrics(runs, keys=("variant",))
    ref = m.where(F.col("variant") == full).select(F.col("roc_auc").alias("_r"), F.col("pr_auc").alias("_p"))
    return m.crossJoin(F.broadcast(ref)).select("variant", "roc_auc", "pr_auc", (F.col("roc_auc") - F.col("_r")).alias("roc_delta"), (F.col("pr_auc") - F.col("_p")).alias("pr_delta"), "n")


def adoption_verdict(a: DataFrame, b: DataFrame, roc: float = 0.005, pr: float = 0.02, flags: int = 0) -> DataFrame:
    """E17. Adopt b over a only if all three gains reach their thresholds; one row each."""
    j = a.select(F.col("roc_auc").alias("r0"), F.col("pr_auc").alias("p0"), F.col("flags").alias("f0")).crossJoin(F.broadcast(b.select("roc_auc", "pr_auc", "flags")))
    d = j.select((F.col("roc_auc") - F.col("r0")).alias("roc_gain"), (F.col("pr_auc") - F.col("p0")).alias("pr_gain"), (F.col("flags") - F.col("f0")).alias("flag_gain"))
    return d.withColumn("adopt", (F.col("roc_gain") >= roc) & (F.col("pr_gain") >= pr) & (F.col("flag_gain") >= flags))


def otsu(df: DataFrame, c: str, bins: int = 64) -> DataFrame:
    """A29. The bin edge with the largest between-class variance."""
    d = df.where(F.col(c).isNotNull()).select(F.col(c).alias("v"))
    box = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    h = d.crossJoin(F.broadcast(box)).groupBy(b.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    up, whole = Window.orderBy("bin"), Window.partitionBy()
    h = h.withColumn("m", mid).withColumns({"n0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("m")).over(up), "N": F.sum("n").over(whole), "S": F.sum(F.col("n") * F.col("m")).over(whole)})
    between = F.try_divide(F.pow(F.col("S") * F.col("n0") / F.col("N") - F.col("s0"), 2), F.col("n0") * (F.col("N") - F.col("n0")))
    edge = F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins
    return h.withColumn("b", F.round(between, 6)).withColumn("edge", edge).agg(F.max_by("edge", F.struct(F.coalesce("b", F.lit(-1.0)), -F.col("bin"))).alias("threshold"))


def calibrate(df: DataFrame, cls: str, v: str, past: float, qs=(0.02, 0.05, 0.25, 0.5, 0.75, 0.95, 0.98)) -> DataFrame:
    """A30. Percentiles per anchor class and the share at or above a threshold."""
    d = df.where(F.col(cls).isNotNull() & F.col(v).isNotNull())
    share = d.groupBy(cls).agg(F.avg((F.col(v) >= past).cast("int")).alias("share"))
    q = quantiles(d, v, qs, (cls,)).select(cls, *(F.col("quantiles")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(qs)))
    return q.join(share, cls)
