"""Queries of the zone statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverlens.operators import composites as M
from riverlens.operators import ranking as T
from riverlens.operators import zonal as Z

from .base import VIEWS, masks, px_pass, px_static, query, r4, scenes, table
from .q_scalars import px_area

VIEWS["union_px"] = "select s.*, coalesce(u.wet, false) as wet from px_area s left join (select pixel, bool_or(wet) as wet from px_pass group by 1) u using (pixel)"
VIEWS["season_px"] = "select pixel, (dayofmonth(day) - 1) // 5 as season, bool_or(wet) as wet from px_pass group by 1, 2"
VIEWS["season_zone"] = """select zone, season, coalesce(sum(case when wet then m2 else 0 end) / 1e4, 0) as flooded_ha, sum(m2) / 1e4 as area_ha,
  coalesce(sum(case when wet then m2 else 0 end) / 1e4, 0) / (sum(m2) / 1e4) as fraction from season_px join px_area using (pixel) where not perm group by 1, 2"""
VIEWS["days_px"] = """select pixel, sum(wet::int + case when wet and before and gap <= 4 then gap - 1 else 0 end)::bigint as days from (
  select *, lag(wet) over w as before, date_diff('day', lag(day) over w, day) as gap from px_pass where dayofmonth(day) not in (5, 6, 13, 14, 15, 16, 17, 22) window w as (partition by pixel order by day)) group by 1"""
VIEWS["duration_px"] = "select *, ((days >= 1)::int + (days >= 3)::int + (days >= 7)::int + (days >= 14)::int) as class from days_px join px_area using (pixel)"
VIEWS["victims"] = """select zone, count(*) filter (where fraction > 0.01) as seasons_1pct, count(*) filter (where fraction > 0.02) as seasons_2pct, max(fraction) as max_fraction, avg(flooded_ha) as mean_ha from season_zone group by 1"""



def union_px(spark, sf):
    u = M.union_masks(px_pass(spark, sf))
    return px_area(spark, sf).join(u, "pixel", "left").withColumn("wet", F.coalesce("wet", F.lit(False)))


def season_px(spark, sf):
    return M.union_masks(px_pass(spark, sf).withColumn("season", F.expr("(dayofmonth(day) - 1) div 5")), ("pixel", "season"))


def season_zone(spark, sf):
    return Z.zone_area(season_px(spark, sf).join(px_area(spark, sf), "pixel"), ("zone", "season"))


def pass_days(spark, sf):
    return px_pass(spark, sf).where("dayofmonth(day) not in (5, 6, 13, 14, 15, 16, 17, 22)")


def duration_px(spark, sf):
    return Z.days_observed_wet(pass_days(spark, sf)).join(px_area(spark, sf), "pixel")


@query("a1_median_composite", "select pixel, phase, round(median(power), 4) as power from scenes group by 1, 2")
def a1(spark, sf):
    return M.median_composite(scenes(spark, sf), ("pixel", "phase")).select("pixel", "phase", r4("power", "power"))


@query("a2_min_composite", "select pixel, phase, min(power) as power from scenes group by 1, 2")
def a2(spark, sf):
    return M.min_composite(scenes(spark, sf), ("pixel", "phase"))


@query("a3_union_masks", "select pixel, (dayofmonth(day) - 1) // 10 as win, bool_or(wet) as wet from px_pass group by 1, 2")
def a3(spark, sf):
    return M.union_masks(px_pass(spark, sf).withColumn("win", F.expr("(dayofmonth(day) - 1) div 10")), ("pixel", "win"))


@query("a4_frequency_count", "select pixel, count(*) filter (where wet) as seasons_wet from season_px group by 1")
def a4(spark, sf):
    return M.frequency_count(season_px(spark, sf))


@query("a5_zone_fractions", "select zone, count(*) filter (where wet)::double as flooded_ha, count(*)::double as area_ha, round(count(*) filter (where wet)::double / count(*), 4) as fraction from union_px group by 1")
def a5(spark, sf):
    return Z.zone_fractions(union_px(spark, sf)).select("zone", "flooded_ha", "area_ha", r4("fraction", "fraction"))


VIEWS["zone_ha"] = "select zone, sum(case when wet then m2 else 0 end) / 1e4 as flooded_ha, sum(m2) / 1e4 as area_ha from union_px where not perm group by 1"


@query("a6_zone_area", "select zone, round(flooded_ha, 4) as flooded_ha, round(area_ha, 4) as area_ha, round(flooded_ha / area_ha, 4) as fraction from zone_ha")
def a6(spark, sf):
    return Z.zone_area(union_px(spark, sf)).select("zone", *(r4(c, c) for c in ("flooded_ha", "area_ha", "fraction")))


@query(
    "a7_window_fractions",
    """with w as (select distinct day, (date '2024-01-01' + ((dayofmonth(day) - 1) // 10 * 10)::int)::date as window_start from px_pass),
    a as (select zone, sum(m2) / 1e4 as area_ha from px_area where not perm group by 1),
    f as (select zone, window_start, sum(m2) / 1e4 as f from (select distinct pixel, window_start from px_pass join w using (day) where wet) join px_area using (pixel) where not perm group by 1, 2)
    select zone, window_start, round(coalesce(f, 0), 4) as flooded_ha, round(area_ha, 4) as area_ha, round(coalesce(f, 0) / area_ha, 4) as fraction
    from a cross join (select distinct window_start from w) left join f using (zone, window_start)""",
)
def a7(spark, sf):
    px = px_pass(spark, sf)
    w = px.select("day").distinct().withColumn("window_start", F.expr("date_add(date '2024-01-01', cast((dayofmonth(day) - 1) div 10 * 10 as int))"))
    return Z.window_fractions(px, px_area(spark, sf), w).select("zone", "window_start", *(r4(c, c) for c in ("flooded_ha", "area_ha", "fraction")))


@query(
    "a8_late_season",
    """with u as (select pixel, (dayofmonth(day) - 1) // 5 as season, bool_or(wet) as wet from px_pass where day >= date '2024-01-11' group by 1, 2),
    z as (select zone, season, sum(case when wet then m2 else 0 end) / 1e4 as ha, sum(m2) / 1e4 as area from u join px_area using (pixel) where not perm group by 1, 2)
    select zone, count(*) filter (where ha / area > 0.01) as seasons_1pct, count(*) filter (where ha / area > 0.02) as seasons_2pct, round(max(ha / area), 4) as max_fraction, round(avg(ha), 4) as mean_ha from z group by 1""",
)
def a8(spark, sf):
    v = Z.late_season(px_pass(spark, sf), px_area(spark, sf), "2024-01-11", F.expr("(dayofmonth(day) - 1) div 5"))
    return v.select("zone", "seasons_1pct", "seasons_2pct", r4("max_fraction", "max_fraction"), r4("mean_ha", "mean_ha"))


@query("a9_repeat_victims", "select zone, seasons_1pct, seasons_2pct, round(max_fraction, 4) as max_fraction, round(mean_ha, 4) as mean_ha from victims")
def a9(spark, sf):
    return Z.repeat_victims(season_zone(spark, sf)).select("zone", "seasons_1pct", "seasons_2pct", r4("max_fraction", "max_fraction"), r4("mean_ha", "mean_ha"))


@query("t3_top_victims", "select zone, seasons_1pct, seasons_2pct, round(max_fraction, 4) as max_fraction, round(mean_ha, 4) as mean_ha from victims order by seasons_2pct desc, victims.max_fraction desc, victims.mean_ha desc, zone limit 5")
def t3(spark, sf):
    return T.top_victims(Z.repeat_victims(season_zone(spark, sf)), 5).select("zone", "seasons_1pct", "seasons_2pct", r4("max_fraction", "max_fraction"), r4("mean_ha", "mean_ha"))


DUR = """select zone, sum(case when class = 1 then m2 / 1e4 else 0 end) as ha_1, sum(case when class = 2 then m2 / 1e4 else 0 end) as ha_2, sum(case when class = 3 then m2 / 1e4 else 0 end) as ha_3,
  sum(case when class = 4 then m2 / 1e4 else 0 end) as ha_4, sum(case when class > 0 then m2 / 1e4 else 0 end) as flooded_ha, avg(case when class > 0 then days end) as mean_days, max(case when class > 0 then days end) as max_days from duration_px where crop group by 1"""
VIEWS["duration_zone"] = DUR


@query("a10_duration_zonal", "select zone, round(ha_1, 4) as ha_1, round(ha_2, 4) as ha_2, round(ha_3, 4) as ha_3, round(ha_4, 4) as ha_4, round(flooded_ha, 4) as flooded_ha, round(mean_days, 4) as mean_days, max_days from duration_zone")
def a10(spark, sf):
    return Z.duration_zonal(duration_px(spark, sf), crop_only=True).select("zone", *(r4(c, c) for c in ("ha_1", "ha_2", "ha_3", "ha_4", "flooded_ha", "mean_days")), "max_days")


@query(
    "a11_duration_damage",
    """select zone, round((ha_1 * 0.1 + ha_2 * 0.35 + ha_3 * 0.7 + ha_4) * 150800.0::double, 4) as damage_inr, round(flooded_ha * 150800.0::double, 4) as naive_inr,
    round(case when flooded_ha > 0 then (ha_1 * 0.1 + ha_2 * 0.35 + ha_3 * 0.7 + ha_4) / flooded_ha end, 4) as damage_fraction from duration_zone""",
)
def a11(spark, sf):
    d = Z.duration_damage(Z.duration_zonal(duration_px(spark, sf), crop_only=True))
    return d.select("zone", *(r4(c, c) for c in ("damage_inr", "naive_inr", "damage_fraction")))


@query("a12_population_exposed", "select zone, round(sum(case when wet then pop else 0 end), 4) as exposed, round(sum(pop), 4) as people, round(sum(case when wet then pop else 0 end) / sum(pop), 4) as share from union_px group by 1")
def a12(spark, sf):
    return Z.population_exposed(union_px(spark, sf)).select("zone", *(r4(c, c) for c in ("exposed", "people", "share")))


@query("a13_method_table", "select zone, count(*) filter (where a)::double as a_ha, count(*) filter (where b)::double as b_ha, count(*) filter (where a and c)::double as crop_ha, count(*)::double as area_ha, round(count(*) filter (where a)::double / count(*), 4) as fraction from masks group by 1")
def a13(spark, sf):
    return Z.method_table(masks(spark, sf)).withColumn("fraction", r4("fraction"))


@query(
    "a14_value_v2",
    """with y as (select n_name as zone, s.p, s.a from nation join (select s_nationkey as k, sum(abs(s_acctbal)) as p, count(*) * 100 as a from supplier group by 1) s on k = n_nationkey),
    c as (select n_name as zone, count(*)::double as crop_ha from customer join nation on n_nationkey = c_nationkey group by 1)
    select c.zone, crop_ha, round(p / a / (2 / 3.0::double), 4) as yield_t_ha, round(crop_ha * (p / a / (2 / 3.0::double)) * 23200, 4) as value_v2, round(crop_ha * 6.5::double * 23200, 4) as value_v1,
    round(crop_ha * (p / a / (2 / 3.0::double)) * 23200 - crop_ha * 6.5::double * 23200, 4) as delta from c left join y using (zone)""",
)
def a14(spark, sf):
    n = table(spark, sf, "nation")
    y = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("zone")).agg(F.sum(F.abs("s_acctbal")).alias("production_t"), (F.count("*") * 100).alias("area_ha"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("zone")).agg(F.count("*").cast("double").alias("crop_ha"))
    return Z.value_v2(y, c).select("zone", "crop_ha", *(r4(x, x) for x in ("yield_t_ha", "value_v2", "value_v1", "delta")))


@query("a27_coverage", "select zone, round(count(*) filter (where ok)::double / count(*), 4) as coverage from (select s.zone, e.pixel is not null as ok from px_static s left join (select distinct user_id as pixel from events where ts::date = date '2024-01-10') e using (pixel)) group by 1")
def a27(spark, sf):
    seen = table(spark, sf, "events").where("to_date(ts) = date '2024-01-10'").select(F.col("user_id").alias("pixel"))
    return Z.coverage(seen, px_static(spark, sf)).withColumn("coverage", r4("coverage"))


@query("a31_polygon_area", "select zone, sum(case when ring = 0 then 1 else -1 end * (x1 - x0) * (y1 - y0)) as area from nation_boxes group by 1")
def a31(spark, sf):
    from riverlens.sources.tables import read_polygons

    from .q_sources import nation_geojson

    return Z.polygon_area(read_polygons(spark, nation_geojson(spark, sf))).withColumn("area", F.round("area", 6))


@query("j16_subtract_mask", "select pixel, day from px_pass where wet and pixel % 17 <> 0")
def j16(spark, sf):
    return Z.subtract_mask(px_pass(spark, sf).where("wet"), px_static(spark, sf).where("perm")).select("pixel", "day")


@query("w5_days_observed_wet", "select pixel, days from days_px")
def w5(spark, sf):
    return Z.days_observed_wet(pass_days(spark, sf))


@query("w6_span_duration", "select pixel, coalesce(date_diff('day', min(day) filter (where wet), max(day) filter (where wet)) + 1, 0)::int as span from px_pass group by 1")
def w6(spark, sf):
    return Z.span_duration(px_pass(spark, sf))


@query("w7_cumulative_and_fresh", "select day, coalesce(fresh, 0)::bigint as fresh, (sum(coalesce(fresh, 0)) over (order by day))::bigint as total from (select distinct day from px_pass) left join (select day, count(*) as fresh from (select pixel, min(day) as day from px_pass where wet group by 1) group by 1) using (day)")
def w7(spark, sf):
    return Z.cumulative_and_fresh(px_pass(spark, sf))


VIEWS["changes"] = """select day, wet_px, new_px, wet_px - lag(wet_px) over (order by day) as delta from (
  select day, count(*) filter (where wet) as wet_px, count(*) filter (where wet and not coalesce(was, false)) as new_px
  from (select *, lag(wet) over (partition by pixel order by day) as was from px_pass) group by 1)"""


@query("w8_pass_change", "select c.day, wet_px, new_px, delta, c.day = (select day from changes order by wet_px desc, day limit 1) as peak from changes c")
def w8(spark, sf):
    c = Z.pass_change(px_pass(spark, sf))
    return c.crossJoin(F.broadcast(Z.peak_day(c))).select("day", "wet_px", "new_px", "delta", (F.col("day") == F.col("peak_day")).alias("peak"))


@query("q6_check_bracket", "select pixel, days, span from days_px join (select pixel, coalesce(date_diff('day', min(day) filter (where wet), max(day) filter (where wet)) + 1, 0)::int as span from px_pass where dayofmonth(day) not in (5, 6, 13, 14, 15, 16, 17, 22) group by 1) using (pixel) where not (days >= 0 and days <= span)")
def q6(spark, sf):
    from riverlens.functions.quality import check_bracket

    p = pass_days(spark, sf)
    return check_bracket(Z.days_observed_wet(p), Z.span_duration(p))
