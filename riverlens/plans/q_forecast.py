"""Queries of the samples, models and profiles. Driver runs of boosted trees use few rounds; the
operators' defaults are the full setting."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverlens.operators import forecast as M
from riverlens.operators import sampling as S
from riverlens.operators import series
from riverlens.operators import zonal as Z
from riverlens.session import scratch

from .base import VIEWS, daily_box, panel, px_static, query, r4, scores, table
from .q_series import res_windows, windows
from .q_zonal import season_zone, union_px

VIEWS["classed_px"] = "select pixel, zone, pixel % 3 = 0 as label from px_static"
VIEWS["drawn"] = "select pixel from px_static where pixel % 17 <> 0 order by md5('s-' || pixel), pixel limit 30"


def classed(spark, sf):
    return px_static(spark, sf).selectExpr("pixel", "zone", "pixel % 3 = 0 as label")


def drawn(spark, sf):
    s = px_static(spark, sf)
    return S.draw(s.select("pixel"), 30, s.where("perm"))


@query(
    "m1_balanced_sample",
    """with z as (select *, count(distinct zone) over (partition by label) as zz from classed_px), f as (select *, row_number() over (partition by label, zone order by md5('s-' || pixel)) <= ceil(20 / zz) as f from (select c.*, z.zz from classed_px c join (select label, count(distinct zone) as zz from classed_px group by 1) z using (label))),
    r as (select *, row_number() over (partition by label order by not f, md5('s-' || pixel)) as rn from f) select pixel, zone, label from r where rn <= 20""".replace("z as (select *, count(distinct zone) over (partition by label) as zz from classed_px), ", ""),
)
def m1(spark, sf):
    return S.balanced_sample(classed(spark, sf), 20).select("pixel", "zone", "label")


@query("m2_draw", "select pixel from drawn")
def m2(spark, sf):
    return drawn(spark, sf)


@query("m3_sample_features", "select pixel, pop, round(elev, 4) as elev from px_static where pixel in (select pixel from drawn)")
def m3(spark, sf):
    return S.sample_features(px_static(spark, sf).select("pixel", "pop", r4("elev", "elev")), drawn(spark, sf))


VIEWS["by_year"] = "select zone, year, avg(fraction) as fraction, sum(flooded_ha) as flooded_ha from panel group by 1, 2"


@query("m11_fold_safe_prior", "select zone, held_out, count(*) filter (where fraction > 0.01) as seasons_1pct, count(*) filter (where fraction > 0.02) as seasons_2pct, round(max(fraction), 4) as max_fraction, round(avg(flooded_ha), 4) as mean_ha from by_year join (select distinct year as held_out from by_year) on year <> held_out group by 1, 2")
def m11(spark, sf):
    y = panel(spark, sf).groupBy("zone", "year").agg(F.avg("fraction").alias("fraction"), F.sum("flooded_ha").alias("flooded_ha"))
    p = M.fold_safe_prior(y)
    return p.select("zone", "held_out", "seasons_1pct", "seasons_2pct", r4("max_fraction", "max_fraction"), r4("mean_ha", "mean_ha"))


@query("m7_variant_features", "select zone, window_start, round(pred, 4) as prob from scores")
def m7(spark, sf):
    return M.persistence(scores(spark, sf).withColumnRenamed("pred", "antecedent")).select("zone", "window_start", r4("prob", "prob"))


@query("m7_ablation_runs")
def m7_fitted(spark, sf):
    """Pooled metrics of all variants, fitted on all years' folds, against the full one."""
    from riverlens.operators.evaluate import ablation_table

    return ablation_table(M.ablation_runs(features(spark, sf), iterations=3))


DAMS = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def features(spark, sf):
    """The panel with its features; rain and reservoirs come by window, the priors by zone from all
    other years."""
    season = panel(spark, sf)
    p = series.assemble(season)
    for box, name in (("punjab_mm", "plain_mm"), ("upstream_mm", "upstream_mm")):
        rain = series.window_with_lags(daily_box(spark, sf), windows(spark), box).toDF("window_start", name, f"{name}_lag1", f"{name}_lag2")
        p = p.join(rain, "window_start", "left")
    of = lambda v, i, dam: F.max(F.when(F.col("dam") == dam, F.col(f"{v}_storage"))).alias(f"dam{i}_{'storage' if v == 'mean' else 'delta'}")
    res = res_windows(spark, sf).groupBy("window_start").agg(*(of(v, i, dam) for i, dam in enumerate(DAMS, 1) for v in ("mean", "delta")))
    by_year = season.groupBy("zone", "year").agg(F.avg("fraction").alias("fraction"), F.sum("flooded_ha").alias("flooded_ha"))
    prior = M.fold_safe_prior(by_year).select("zone", F.col("held_out").alias("year"), F.col("mean_ha").alias("prior_mean_ha"), F.col("seasons_2pct").alias("prior_seasons_2pct"))
    y = p.agg(F.percentile("fraction", F.lit(0.9)).alias("q"))
    j = p.join(res, "window_start", "left").join(prior, ["zone", "year"], "left").crossJoin(F.broadcast(y))
    return j.select("zone", "year", "window_start", (F.col("fraction") > F.col("q")).cast("double").alias("y"), F.col("fraction").alias("truth"), *M.FEATURE_ORDER)


@query("m4_train_pixel_classifier")
def m4(spark, sf):
    """All components, the stated number of trees: folds, importances and the share of every class predicted wet."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") < 5).cast("double").alias("t"), (F.col("vec_id") % 2).alias("fold"), "embedding")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"f{i}" for i in range(width)]
    x = e.select("vec_id", "t", "fold", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)))
    _, folds, importances, predicted = M.train_pixel_classifier(x, names, "t", "fold")
    tall = [F.lit(c).alias("what") for c in ("fold", "importance", "predicted")]
    out = folds.select(tall[0], F.col("fold").cast("string").alias("name"), F.col("accuracy").alias("value"))
    out = out.union(importances.select(tall[1], "feature", "importance"))
    return out.union(predicted.select(tall[2], F.col("vec_id").cast("string"), "prob"))


@query("m5_loyo_oof")
def m5(spark, sf):
    return M.loyo_oof(features(spark, sf), M.FEATURE_ORDER, iterations=3)


@query("m6_hindcast")
def m6(spark, sf):
    return M.hindcast(features(spark, sf), M.FEATURE_ORDER, 2001, iterations=3)[2]


@query("m8_permutation_importance")
def m8(spark, sf):
    f = features(spark, sf)
    model = M.hindcast(f, M.FEATURE_ORDER, 2001, iterations=3)[0]
    return M.permutation_importance(model, M.typed(f.where("year = 2001"), M.FEATURE_ORDER), M.FEATURE_ORDER)


LIVE = "window_start = date '2001-07-25'"
_RAIN = ", ".join(
    f"(select sum({box}) from daily_box where date >= date '2001-07-25' - {10 * k} and date < date '2001-08-04' - {10 * k}) as {name}{f'_lag{k}' if k else ''}"
    for k in range(3) for box, name in (("punjab_mm", "plain_mm"), ("upstream_mm", "upstream_mm"))
)
_DAMS = ", ".join(
    f"(select {v}_storage from res_windows where window_start = date '2001-07-25' and dam = '{dam}') as dam{i}_{'storage' if v == 'mean' else 'delta'}" for i, dam in enumerate(DAMS, 1) for v in ("mean", "delta")
)
VIEWS["state_live"] = f"select 4 as week, {_RAIN}, {_DAMS}"
_ROUNDED = [c for c in M.FEATURE_ORDER if c not in ("week", "prior_seasons_2pct")]


def live(spark, sf):
    f = features(spark, sf).where(LIVE)
    scalars = f.select("week", *M.RAIN, *M.RESERVOIRS).limit(1)  # the same in every zone
    return M.live_features(f, scalars, f.select("zone", "antecedent"), f.select("zone", *M.PRIORS))


@query(
    "m9_live_features",
    f"""select zone, week, prior_seasons_2pct, {", ".join(f"round({c}, 4) as {c}" for c in _ROUNDED)}
    from (select zone, window_start, lag(fraction) over (partition by zone order by window_start) as antecedent from panel) a
    join (select zone, count(*) filter (where fraction > 0.02) as prior_seasons_2pct, avg(flooded_ha) as prior_mean_ha from by_year where year <> 2001 group by 1) p using (zone) cross join state_live where window_start = date '2001-07-25'""",
)
def m9(spark, sf):
    return live(spark, sf).select("zone", "week", "prior_seasons_2pct", *(r4(c, c) for c in _ROUNDED))


@query("m10_score_live")
def m10(spark, sf):
    """Scores of the live frame by the model that the hindcast left in the shared folder."""
    path = scratch(spark, "forecaster")
    M.hindcast(features(spark, sf), M.FEATURE_ORDER, 2001, iterations=3, save_to=path)
    model = M.load_model(spark, path, M.FEATURE_ORDER, before=2001)
    return M.score_live(model, live(spark, sf), M.FEATURE_ORDER, core=True).select("zone", "prob")


@query(
    "j15_zone_profile",
    """with m as (select zone, count(*) filter (where wet)::double as wet_ha, count(*) filter (where wet and crop)::double as crop_ha from union_px group by 1), p as (select zone, sum(case when wet then pop else 0 end) as exposed from union_px group by 1),
    k as (select zone, max(fraction) as peak from season_zone group by 1), s as (select zone, string_agg(pixel::varchar, ',' order by pixel) as subs from px_static group by 1)
    select zone, wet_ha, crop_ha, seasons_2pct, round(exposed, 4) as exposed, round(peak, 4) as peak, subs from m left join victims using (zone) left join p using (zone) left join k using (zone) left join s using (zone)""",
)
def j15(spark, sf):
    u = union_px(spark, sf)
    season = season_zone(spark, sf)
    m = Z.method_table(u.withColumnRenamed("wet", "a").withColumn("b", F.col("a")), ("a", "b"), "crop").select("zone", F.col("a_ha").alias("wet_ha"), "crop_ha")
    j = M.zone_profile(m, Z.repeat_victims(season), Z.population_exposed(u), season.groupBy("zone").agg(F.max("fraction").alias("peak")), px_static(spark, sf).select("zone", F.col("pixel").alias("sub"), F.col("pop").alias("km2")))
    subs = F.array_join(F.transform("sub_zones", lambda x: x["sub"].cast("string")), ",")
    return j.select("zone", "wet_ha", "crop_ha", "seasons_2pct", r4("exposed", "exposed"), r4("peak", "peak"), subs.alias("subs"))
