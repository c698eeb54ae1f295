"""Queries of the statistics and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverlens.functions.quality import gate
from riverlens.operators import evaluate as E

from .base import VIEWS, inline, masks, official, query, r4, scores
from .q_scalars import composite, ndwi
from .q_series import indices

VIEWS["long_idx"] = "select 'total' as series, year, total as v from indices union all select 'heavy', year, heavy_days::double from indices"


def long_idx(spark, sf):
    i = indices(spark, sf)
    return i.select(F.lit("total").alias("series"), "year", F.col("total").alias("v")).union(i.select(F.lit("heavy"), "year", F.col("heavy_days").cast("double")))


def _kendall(of: str) -> str:
    return f"""with s as (select a.series, sum(sign(b.v - a.v))::double as s from {of} a join {of} b on a.series = b.series and a.year < b.year group by 1),
  k as (select series, sum(k)::bigint as n, sum(k * (k - 1) * (2 * k + 5)) as t5, sum(k * (k - 1) / 2) as t0 from (select series, v, count(*) as k from {of} group by 1, 2) group by 1),
  w as (select series, n, s, ((n * (n - 1) * (2 * n + 5) - t5) / 18)::double as var_s, t0 from s join k using (series))
  select *, case when s > 0 then (s - 1) / sqrt(var_s) when s < 0 then (s + 1) / sqrt(var_s) else 0 end::double as z from w"""


#: Both tails of the normal distribution: terms x^(2n + 1) / gamma(n + 3/2) of erf.
TAILS = "case when z = 0 then 1 else greatest(0, 1 - exp(-z * z / 2) * list_sum(list_transform(range(0, 300), lambda n: exp((2 * n + 1) * ln(abs(z) / sqrt(2)) - lgamma(n + 1.5))))) end"
VIEWS["kendall"] = _kendall("long_idx")


@query("e1_mann_kendall", f"select series, n, s, round(var_s, 4) as var_s, round(z, 4) as z, round({TAILS}, 4) as p, round(s / sqrt((n * (n - 1) / 2 - t0) * n * (n - 1) / 2), 4) as tau from kendall")
def e1(spark, sf):
    m = E.mann_kendall(long_idx(spark, sf), "year", "v")
    return m.select("series", "n", "s", *(r4(c, c) for c in ("var_s", "z", "p", "tau")))


VIEWS["slopes"] = "select a.series, median((b.v - a.v) / (b.year - a.year)) as slope from long_idx a join long_idx b on a.series = b.series and a.year < b.year group by 1"
VIEWS["autocorr"] = "with d as (select series, year, v - avg(v) over (partition by series) as d from long_idx), p as (select *, lag(d) over (partition by series order by year) as p from d) select series, sum(d * p) / sum(d * d) as r1, count(*) as n from p group by 1"
VIEWS["tested_idx"] = """select series, year, v from long_idx join autocorr using (series) where abs(r1) <= 1.96 / sqrt(n)
  union all select series, year, v - r1 * p from (select series, year, v, lag(v) over (partition by series order by year) as p from long_idx) join autocorr using (series) where abs(r1) > 1.96 / sqrt(n) and p is not null"""
VIEWS["tested"] = _kendall("tested_idx")


@query(
    "e2_trend_table",
    f"""with t as (select series, z, {TAILS} as p from tested)
    select series, round(r1, 4) as r1, abs(r1) > 1.96 / sqrt(n) as whitened, round(slope, 4) as slope, round(z, 4) as z, round(p, 4) as p, case when p >= 0.05 then 'no trend' when z > 0 then 'increasing' else 'decreasing' end as verdict
    from autocorr join slopes using (series) join t using (series)""",
)
def e2(spark, sf):
    return E.trend_table(long_idx(spark, sf), "year", "v").select("series", "whitened", "verdict", *(r4(c, c) for c in ("r1", "slope", "z", "p")))


@query("e3_sens_slope", "select series, round(slope, 4) as slope from slopes")
def e3(spark, sf):
    return E.sens_slope(long_idx(spark, sf), "year", "v").select("series", r4("slope", "slope"))


@query("e4_return_period", "with t as (select total as value from indices where year = 2000), a as (select count(*) as n, count(*) filter (where total > value) + 1 as rank from indices, t) select n, rank, round((n + 1) / rank, 4) as return_period, round(rank / (n + 1), 4) as exceedance from a")
def e4(spark, sf):
    return E.return_period(indices(spark, sf), "year", "total", 2000).select("n", "rank", r4("return_period", "return_period"), r4("exceedance", "exceedance"))


@query("e5_anomaly", "with t as (select total as value from indices where year = 2000) select value, round(avg(total), 4) as mean, round(stddev_samp(total), 4) as std, round(100.0::double * count(*) filter (where total <= value) / count(*), 4) as percentile, count(*) filter (where total > value) + 1 as rank, max(total) as max, round((value - avg(total)) / stddev_samp(total), 4) as z, round(value / avg(total), 4) as ratio from indices, t where year < 2000 group by value")
def e5(spark, sf):
    a = E.anomaly(indices(spark, sf), "year", "total", 2000)
    return a.select("value", *(r4(c, c) for c in ("mean", "std", "percentile")), "rank", "max", r4("z", "z"), r4("ratio", "ratio"))


CELLS = "count(*) filter (where valid and {p} and truth) as tp, count(*) filter (where valid and {p} and not truth) as fp, count(*) filter (where valid and not {p} and truth) as fn, count(*) filter (where valid and not {p} and not truth) as tn"
METRICS = "round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 4) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 4) as iou, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as dice"
NAMES = ("accuracy", "precision", "recall", "f1", "iou", "dice")


@query("e6_confusion", f"select {CELLS.format(p='a')} from masks")
def e6(spark, sf):
    return E.confusion(masks(spark, sf), "a", "truth", "valid")


@query("e7_agreement_metrics", f"select 'all' as part, {METRICS} from (select {CELLS.format(p='a')} from masks) union all select 'none', 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double")
def e7(spark, sf):
    m = masks(spark, sf)
    out = [E.agreement_metrics(E.confusion(d, "a", "truth", "valid")).select(F.lit(k).alias("part"), *(r4(c, c) for c in NAMES)) for k, d in (("all", m), ("none", m.where("false")))]
    return out[0].union(out[1])


@query("e8_zone_agreement", f"select zone, tp, {METRICS.split(', round')[0]}, round(coalesce((tp + fp) / nullif(tp + fp + fn + tn, 0), 0), 4) as fraction_a, round(coalesce((tp + fn) / nullif(tp + fp + fn + tn, 0), 0), 4) as fraction_b from (select zone, {CELLS.format(p='a').replace('truth', 'b')} from masks group by 1)")
def e8(spark, sf):
    z = E.zone_agreement(masks(spark, sf), "a", "b", "valid")
    return z.select("zone", "tp", *(r4(c, c) for c in ("accuracy", "fraction_a", "fraction_b")))


ONE = "select '{m}' as mask, " + CELLS
THREE = " union all ".join(ONE.format(m=m, p=m) + " from masks" for m in "abc")


@query("e9_score_masks", f"select mask, tp, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall, round(fn / (tp + fn), 4) as recession from ({THREE})")
def e9(spark, sf):
    return E.score_masks(masks(spark, sf), ["a", "b", "c"]).select("mask", "tp", *(r4(c, c) for c in ("precision", "recall", "recession")))


@query("e18_method_benchmark", f"select mask, (tp + fp)::double as area_ha, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall, round(tp / (tp + fp + fn), 4) as iou, round(2 * tp / (2 * tp + fp + fn), 4) as f1 from ({THREE.replace('valid and ', '')})")
def e18(spark, sf):
    return E.method_benchmark(masks(spark, sf), ["a", "b", "c"], "truth").select("mask", "area_ha", *(r4(c, c) for c in ("precision", "recall", "iou", "f1")))


RHO = "select corr(ra, rb) as rho, avg(abs(ours - theirs)) as mae, count(*) as n from (select ours, theirs, rank() over (order by ours) + (count(*) over (partition by ours) - 1) / 2 as ra, rank() over (order by theirs) + (count(*) over (partition by theirs) - 1) / 2 as rb from ({t}) where theirs is not null and ours is not null)"


@query("e10_spearman", f"select round(rho, 4) as rho, round(mae, 4) as mae, n from ({RHO.format(t='select * from official')})")
def e10(spark, sf):
    return E.spearman(official(spark, sf), "ours", "theirs").select(r4("rho", "rho"), r4("mae", "mae"), "n")


@query("e11_official_compare", f"select 'named' as variant, round(rho, 4) as rho, n from ({RHO.format(t='select * from official')}) union all select 'all', round(rho, 4), n from ({RHO.format(t='select ours, coalesce(theirs, 0) as theirs from official')})")
def e11(spark, sf):
    o = official(spark, sf)
    return E.official_compare(o.select("zone", "ours"), o.select("zone", "theirs")).withColumn("rho", r4("rho"))


VIEWS["runs"] = "select 'full' as variant, y, prob from scores union all select 'flat', y, 0.5::double from scores union all select 'late', y, case when month(window_start) >= 8 then prob else 0 end from scores"
VIEWS["roc"] = """with r as (select variant, y, prob, rank() over (partition by variant order by prob) + (count(*) over (partition by variant, prob) - 1) / 2 as rk from runs),
  g as (select variant, prob, sum(y) as pos, count(*) as n from runs group by 1, 2), c as (select variant, pos, sum(pos) over w as cpos, sum(n) over w as cn, sum(pos) over (partition by variant) as p from g window w as (partition by variant order by prob desc)),
  a as (select variant, sum(case when y = 1 then rk end) as rs, sum(y) as p, count(*) as n, count(*) filter (where prob >= 0.5 and y = 1) as tp, count(*) filter (where prob >= 0.5) as pp from r group by 1)
  select a.variant, (rs - a.p * (a.p + 1) / 2) / (a.p * (n - a.p)) as roc_auc, ap as pr_auc, a.p::bigint as p, n, tp, pp from a join (select variant, sum(pos * cpos / (p * cn)) as ap from c group by 1) b using (variant)"""


def runs(spark, sf):
    s = scores(spark, sf)
    full = s.select(F.lit("full").alias("variant"), "y", "prob")
    return full.union(s.select(F.lit("flat"), "y", F.lit(0.5))).union(s.select(F.lit("late"), "y", F.expr("if(month(window_start) >= 8, prob, 0d)")))


@query("e12_classification_metrics", "select variant, round(roc_auc, 4) as roc_auc, round(pr_auc, 4) as pr_auc, round(2 * tp / (pp + p), 4) as f1, round(coalesce(tp / nullif(pp, 0), 0), 4) as precision, round(tp / p, 4) as recall, round(p / n, 4) as base_rate, n from roc")
def e12(spark, sf):
    m = E.classification_metrics(runs(spark, sf), keys=("variant",))
    return m.select("variant", *(r4(c, c) for c in ("roc_auc", "pr_auc", "f1", "precision", "recall", "base_rate")), "n")


@query("a25_metrics_by_year", "select coalesce(year::varchar, 'POOLED') as year, count(*) as n, sum(y)::bigint as events, round(avg(y), 4) as base_rate, round(avg(abs(truth - pred)), 4) as mae, round(avg((y - prob) * (y - prob)), 4) as brier from scores group by grouping sets ((scores.year), ())")
def a25(spark, sf):
    m = E.metrics_by_year(scores(spark, sf))
    return m.select("year", "n", "events", *(r4(c, c) for c in ("base_rate", "mae", "brier")))


@query("j14_side_by_side", "with a as (select year, avg(prob) as m from scores group by 1), b as (select year, avg(truth) as m from scores group by 1) select year, round(a.m, 4) as m_a, round(b.m, 4) as m_b, round(b.m - a.m, 4) as m_delta from a join b using (year)")
def j14(spark, sf):
    s = scores(spark, sf)
    j = E.side_by_side(s.groupBy("year").agg(F.avg("prob").alias("m")), s.groupBy("year").agg(F.avg("truth").alias("m")), "year", "m")
    return j.select("year", *(r4(c, c) for c in ("m_a", "m_b", "m_delta")))


@query("e13_conformal_quantile", "select round(max(r) filter (where k = ceil((n + 1) * 0.9 - 1e-9)), 4) as radius, max(n) as n from (select abs(truth - pred) as r, row_number() over (order by abs(truth - pred)) as k, count(*) over () as n from scores)")
def e13(spark, sf):
    s = scores(spark, sf).withColumn("residual", F.abs(F.col("truth") - F.col("pred")))
    return E.conformal_quantile(s, "residual", 0.9).select(r4("radius", "radius"), "n")


@query(
    "e14_loyo_conformal",
    """with o as (select h.year as held, abs(truth - pred) as r from scores s join (select distinct year from scores) h on s.year <> h.year),
    k as (select *, row_number() over (partition by held order by r) as k, count(*) over (partition by held) as n from o), l as (select unnest([0.8::double, 0.9::double]) as level),
    q as (select held as year, level, max(r) filter (where k = ceil((n + 1) * level - 1e-9)) as radius from k, l group by 1, 2)
    select year, round(max(radius), 4) as radius, round(avg((truth between greatest(0, pred - radius) and least(1, pred + radius))::int), 4) as coverage, round(avg(least(1, pred + radius) - greatest(0, pred - radius)), 4) as width, level from scores join q using (year) group by year, level""",
)
def e14(spark, sf):
    c = E.loyo_conformal(scores(spark, sf), [0.8, 0.9])
    return c.select("year", *(r4(x, x) for x in ("radius", "coverage", "width")), "level")


@query(
    "e15_flag_sheet",
    """with r as (select *, rank() over (partition by window_start order by prob desc) as k from scores)
    select year, zone, min(k)::int as best_rank, round(max(prob), 4) as best_prob, min(case when k <= 5 then window_start end) as first_window, min(k) <= 5 and max(prob) >= 0.2 as flagged from r group by 1, 2""",
)
def e15(spark, sf):
    return E.flag_sheet(scores(spark, sf), keys=("year",)).withColumn("best_prob", r4("best_prob"))


@query("e16_ablation_table", "select a.variant, round(a.roc_auc, 4) as roc_auc, round(a.pr_auc, 4) as pr_auc, round(a.roc_auc - f.roc_auc, 4) as roc_delta, round(a.pr_auc - f.pr_auc, 4) as pr_delta, a.n from roc a, roc f where f.variant = 'full'")
def e16(spark, sf):
    t = E.ablation_table(runs(spark, sf))
    return t.select("variant", *(r4(c, c) for c in ("roc_auc", "pr_auc", "roc_delta", "pr_delta")), "n")


FLAGS = "select count(*) filter (where k <= 5 and p >= 0.2) as n from (select zone, min(k) as k, max(prob) as p from (select zone, {p} as prob, rank() over (partition by window_start order by {p} desc) as k from scores) group by zone)"


@query(
    "e17_adoption_verdict",
    f"""with fa as ({FLAGS.format(p="case when month(window_start) >= 8 then prob else 0 end")}), fb as ({FLAGS.format(p="prob")})
    select round(b.roc_auc - a.roc_auc, 4) as roc_gain, round(b.pr_auc - a.pr_auc, 4) as pr_gain, fb.n - fa.n as flag_gain,
      b.roc_auc - a.roc_auc >= 0.005 and b.pr_auc - a.pr_auc >= 0.02 and fb.n - fa.n >= 0 as adopt from roc a, roc b, fa, fb where a.variant = 'late' and b.variant = 'full'""",
)
def e17(spark, sf):
    """The full variant over the late one; each one's flags are those of its own sheet."""
    t, s = E.ablation_table(runs(spark, sf)), scores(spark, sf)
    late = s.withColumn("prob", F.expr("if(month(window_start) >= 8, prob, 0d)"))
    flags = [E.flag_sheet(x).agg(F.count_if("flagged").alias("flags")) for x in (late, s)]
    a, b = (t.where(F.col("variant") == v).crossJoin(F.broadcast(f)) for v, f in zip(("late", "full"), flags, strict=True))
    v = E.adoption_verdict(a, b)
    return v.select(r4("roc_gain", "roc_gain"), r4("pr_gain", "pr_gain"), "flag_gain", "adopt")



@query("q5_gate", "select * from (select 'n' as metric, n::double as value, (select count(*) from scores)::double as target, true as ok from roc where variant = 'full' union all select 'roc_auc', round(roc_auc, 4), 2.0::double, false from roc where variant = 'full' union all select 'unknown', null, 1.0::double, false)")
def q5(spark, sf):
    s = scores(spark, sf)
    m = E.classification_metrics(s).select(F.expr("stack(2, 'n', cast(n as double), 'roc_auc', round(roc_auc + 1e-9, 4)) as (metric, value)"))
    t = s.agg(F.count("*").cast("double").alias("target")).select(F.lit("n").alias("metric"), "target").union(inline(spark, [("roc_auc", 2.0), ("unknown", 1.0)], "metric string, target double"))
    return gate(m, t, 0.01)


@query(
    "a29_otsu",
    """with d as (select post - pre as v from composite where post is not null and pre is not null), x as (select min(v) as lo, max(v) as hi from d),
    h as (select least(floor((v - lo) / (hi - lo) * 64), 63) as bin, lo, hi, count(*) as n from d, x group by 1, 2, 3), m as (select *, lo + (bin + 0.5) * (hi - lo) / 64 as m from h),
    c as (select *, sum(n) over w as n0, sum(n * m) over w as s0, sum(n) over () as t, sum(n * m) over () as s from m window w as (order by bin)),
    b as (select bin, lo + (bin + 1) * (hi - lo) / 64 as edge, round(case when t > n0 then (s * n0 / t - s0) * (s * n0 / t - s0) / (n0 * (t - n0)) end, 6) as b from c)
    select round(edge, 4) as threshold from b order by coalesce(b.b, -1) desc, bin limit 1""",
)
def a29(spark, sf):
    c = composite(spark, sf).select((F.col("post") - F.col("pre")).alias("dvv"))
    return E.otsu(c, "dvv").select(r4("threshold", "threshold"))


QS = (0.02, 0.05, 0.25, 0.5, 0.75, 0.95, 0.98)


@query("a30_calibrate", "with c as (select *, (case when scl in (0, 1, 3, 8, 9, 10) then null when ndwi >= 0.1 then 1 when ndwi <= -0.1 then 0 end)::int as water from index_px) select water, " + ", ".join(f"round(quantile_cont(ndwi, {q}), 4) as p{round(100 * q)}" for q in QS) + ", round(avg((ndwi >= -0.3)::int), 4) as share from c where water is not null group by 1")
def a30(spark, sf):
    from riverlens.functions.scalars import classify_water

    c = E.calibrate(ndwi(spark, sf).withColumn("water", classify_water("ndwi", "scl")), "water", "ndwi", -0.3)
    return c.select("water", *(r4(x, x) for x in c.columns if x != "water"))
