"""Queries of the projections, predicates and unit rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverlens.functions import scalars as P
from riverlens.operators import composites

from .base import VIEWS, dam_daily, inline, masks, px_static, query, r4, scenes, table

VIEWS["composite"] = """
select pixel, case when pre is not null then 10 * log10(greatest(pre, 1e-6)) end as pre, case when post is not null then 10 * log10(greatest(post, 1e-6)) end as post from (
  select pixel, median(case when phase = 'pre' then power end) as pre, median(case when phase = 'wet' then power end) as post from scenes group by pixel)"""
VIEWS["ground"] = """select c.*, pixel % 17 = 0 as perm, (pixel % 100)::double as occurrence, (pixel % 11)::double as slope, (pixel % 300)::double as elev from composite c"""


def composite(spark, sf):
    return composites.phases(scenes(spark, sf))


def ground(spark, sf):
    return composite(spark, sf).selectExpr("*", "pixel % 17 = 0 as perm", "cast(pixel % 100 as double) as occurrence", "cast(pixel % 11 as double) as slope", "cast(pixel % 300 as double) as elev")


TIER = "coalesce(post - pre < -3 and post < -15 and pre >= -15, false)"


@query("p1_to_db", "select pixel, orbit, ts, power, round(10 * log10(greatest(power, 1e-6)), 4) as db from scenes where power is not null union all select pixel, orbit, ts, null, null from scenes where power is null")
def p1(spark, sf):
    return scenes(spark, sf).select("pixel", "orbit", "ts", "power", r4(P.to_db("power"), "db"))


@query("p2_tier_a", f"select pixel, {TIER} as wet from composite")
def p2(spark, sf):
    return composite(spark, sf).select("pixel", P.tier_a("post", "pre").alias("wet"))


@query("p3_water_single", "select pixel, coalesce(post < -15 and not perm and post is not null, false) as water from ground")
def p3(spark, sf):
    return ground(spark, sf).select("pixel", P.water_single("post", "perm", F.col("post").isNotNull()).alias("water"))


@query("p4_wet_for_window", f"select pixel, {TIER} and not occurrence >= 60 and not slope > 5 as wet from ground")
def p4(spark, sf):
    return ground(spark, sf).select("pixel", P.wet_for_window("post", "pre", "occurrence", "slope").alias("wet"))


@query(
    "p5_agreement_label",
    """select id, (case when not valid or c or zone = 7 or (case when zone = 7 then null when zone = 3 then -16 else -10 end) < -15 then -1 when a and b then 1 when not a and not b then 0 else -1 end)::int as label from masks""",
)
def p5(spark, sf):
    m = masks(spark, sf).withColumn("pre", F.expr("case when zone = 7 then null when zone = 3 then -16.0d else -10.0d end"))
    return m.select("id", P.agreement_label("a", "b", "c", "pre", "valid").alias("label"))


@query(
    "p6_strict_label",
    "select pixel, (case when coalesce(post - pre < -5 and post < -16 and slope < 2, false) and not perm then 1 when coalesce(post - pre > -1 and post > -13, false) and not perm then 0 end)::int as label from ground",
)
def p6(spark, sf):
    return ground(spark, sf).select("pixel", P.strict_label(F.col("post") - F.col("pre"), "post", "slope", "perm").alias("label"))


@query(
    "p7_feature_stack",
    """select pixel, round(post, 4) as post_vv, round(post - 6, 4) as post_vh, round(post - (post - 6), 4) as vv_vh, round(post - pre, 4) as dvv, round((post - 6) - (pre - 7), 4) as dvh, slope, elev as elevation, occurrence from ground""",
)
def p7(spark, sf):
    g = ground(spark, sf).selectExpr("pixel", "post as post_vv", "post - 6 as post_vh", "pre as pre_vv", "pre - 7 as pre_vh", "slope", "elev as elevation", "occurrence")
    f = P.feature_stack(g)
    return f.select("pixel", *(r4(c, c) for c in ("post_vv", "post_vh", "vv_vh", "dvv", "dvh")), "slope", "elevation", "occurrence")


@query("p8_reflectance", "select p_partkey, case when p_size <> 1 then round((p_size * 100 - 1000) / 10000.0::double, 4) end as reflectance from part")
def p8(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r4(P.reflectance(F.expr("if(p_size = 1, 0, p_size * 100)")), "reflectance"))


VIEWS["index_px"] = "select p_partkey, p_partkey % 12 as scl, (p_size - p_retailprice / 30) / (p_size + p_retailprice / 30) as ndwi from part"


def ndwi(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr("p_partkey % 12").alias("scl"), P.ndwi("p_size", F.col("p_retailprice") / 30).alias("ndwi"))


@query("p9_ndwi", "select p_partkey, round(ndwi, 4) as ndwi from index_px union all select -1, null")
def p9(spark, sf):
    zero = inline(spark, [(-1, 0.0, 0.0)], "p_partkey long, g double, n double").select("p_partkey", P.ndwi("g", "n").alias("ndwi"))
    return ndwi(spark, sf).select("p_partkey", r4("ndwi", "ndwi")).union(zero)


@query("p10_classify_water", "select p_partkey, (case when scl in (0, 1, 3, 8, 9, 10) then null when ndwi >= 0.1 then 1 when ndwi <= -0.1 then 0 end)::int as water from index_px")
def p10(spark, sf):
    return ndwi(spark, sf).select("p_partkey", P.classify_water("ndwi", "scl").alias("water"))


@query(
    "p11_palette_class",
    """select p_partkey, abs(220 + p_size - 232) <= 10 and abs(60 + p_size - 76) <= 10 and abs(100 + p_size - 120) <= 10 and p_size * 6 >= 128 as wet,
    abs(p_size - 10 - 0) <= 10 and abs(60 + p_size - 75) <= 10 and abs(100 + p_size - 114) <= 10 and p_size * 6 >= 128 as ref from part""",
)
def p11(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "220 + p_size as r", "60 + p_size as g", "100 + p_size as b", "p_size * 6 as a", "p_size - 10 as r2")
    return p.select("p_partkey", P.palette_class("r", "g", "b", "a", (232, 76, 120)).alias("wet"), P.palette_class("r2", "g", "b", "a", (0, 75, 114)).alias("ref"))


VIEWS["px_area"] = """select *, pow(cos(2 * atan(exp((3600000 - "row" * 100) / 6378137.0::double)) - 1.5707963267948966::double), 2) * 100 * 100 as m2 from px_static"""


def px_area(spark, sf):
    return px_static(spark, sf).withColumn("m2", P.pixel_area_m2(3600000 - F.col("row") * 100, 100.0))


@query("p12_pixel_area_m2", "select pixel, round(m2, 4) as m2 from px_area")
def p12(spark, sf):
    return px_area(spark, sf).select("pixel", r4("m2", "m2"))


@query("p13_to_density", "select pixel, round(pop / m2 * 1e6, 4) as per_km2, round(pop / m2 * m2, 4) as counts from px_area union all select -1, 0.0::double, 0.0::double")
def p13(spark, sf):
    a = px_area(spark, sf).select("pixel", "pop", "m2").union(inline(spark, [(-1, None, 10000.0)], "pixel long, pop double, m2 double"))
    d = P.to_density("pop", "m2")
    return a.select("pixel", r4(d * 1e6, "per_km2"), r4(P.to_counts(d, "m2"), "counts"))


@query(
    "p14_edge_class",
    "select pixel, ((n >= 1)::int + (n >= 2)::int + (n >= 4)::int) as recurrence, ((n >= 1)::int + (n >= 3)::int + (n >= 7)::int + (n >= 14)::int) as duration from (select pixel, count(*) filter (where wet) as n from px_pass group by 1)",
)
def p14(spark, sf):
    from riverlens import config as C

    from .base import px_pass

    n = composites.frequency_count(px_pass(spark, sf))
    return n.select("pixel", P.edge_class("seasons_wet", C.RECURRENCE_EDGES).alias("recurrence"), P.edge_class("seasons_wet", C.DURATION_EDGES).alias("duration"))


@query(
    "p15_pixel_xy",
    'select pixel, (pixel // 32)::bigint as "row", pixel % 32 as col, round(500000 + (pixel % 32 + 0.5::double) * 90, 4) as x, round(3600000 - (pixel // 32 + 0.5::double) * 90, 4) as y from px_static',
)
def p15(spark, sf):
    return px_static(spark, sf).select("pixel", *P.pixel_xy("pixel", 32, 500000.0, 3600000.0, 90.0))


@query(
    "p17_to_ha",
    """select l_orderkey, l_linenumber, unit, round(l_quantity * case unit when 'Mha' then 1e6 when 'lakh_ha' then 1e5 else 1 end, 4) as ha, round(l_extendedprice / 100, 4) as km2, round(l_quantity * 0.3048::double, 4) as m,
      round(l_quantity * 1000 * 0.028316846592::double * 86400 / 1e9, 4) as bcm,
      round(l_quantity * case l_linenumber % 5 when 0 then 1e6 when 1 then 1e5 else 1 end, 4) as value, case l_linenumber % 5 when 3 then 'count' when 4 then 'crore_inr' else 'ha' end as value_unit from (select *, case l_linenumber % 3 when 0 then 'Mha' when 1 then 'lakh_ha' else ' HA ' end as unit from lineitem)""",
)
def p17(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("unit", F.expr("case l_linenumber % 3 when 0 then 'Mha' when 1 then 'lakh_ha' else ' HA ' end"))
    q, price = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    any_unit = F.expr("array('Mha', 'lakh_ha', 'ha', ' Count', 'crore_inr')[cast(l_linenumber % 5 as int)]")
    l = l.withColumn("v", P.normalize_value(q, any_unit))
    return l.select("l_orderkey", "l_linenumber", "unit", r4("v.value", "value"), F.col("v.unit").alias("value_unit"), r4(P.to_ha(q, "unit"), "ha"), r4(P.km2(price), "km2"), r4(P.feet_to_m(q), "m"), r4(P.cusec_to_bcm_day(q * 1000), "bcm"))


METRICS = "['max_area_affected', 'area_affected', 'crop_damage_area', 'crop_damage_value', 'lives_lost', 'houses_damaged', 'unheard_of']"


@query("p18_metric_class", f"select p_partkey, metric, 'wet_area' as class from (select p_partkey, ({METRICS})[p_size % 7 + 1] as metric from part) where metric in ('max_area_affected', 'area_affected')")
def p18(spark, sf):
    m = table(spark, sf, "part").selectExpr("p_partkey", f"array({METRICS[1:-1]})[p_size % 7] as metric")
    return P.milestones(m, "wet_area").select("p_partkey", "metric", P.metric_class("metric").alias("class"))


@query("p19_num", "select event_id, try_cast(regexp_extract(props, '\\d+') as double) as k from events union all select * from (values (-1, null), (-2, null), (-3, 3.5), (-4, null)) v")
def p19(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("t"))
    more = inline(spark, [(-1, "NA"), (-2, " "), (-3, " 3.5 "), (-4, "NaN")], "event_id long, t string")
    return e.union(more).select("event_id", P.num("t").alias("k"))


@query("p20_pct_of_capacity", "select date, dam, round(100 * storage / (2 + ascii(dam) - 48), 4) as pct_capacity from dam_daily")
def p20(spark, sf):
    d = dam_daily(spark, sf)
    cap = inline(spark, [(x, 2.0 + int(x[0])) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")], "dam string, capacity double")
    return P.pct_of_capacity(d, cap).select("date", "dam", r4("pct_capacity", "pct_capacity"))


@query("p21_value_at_risk", "select zone, window_start, round(flooded_ha * 6.5::double * 23200, 4) as inr from panel")
def p21(spark, sf):
    from .base import panel

    return panel(spark, sf).select("zone", "window_start", r4(P.value_at_risk("flooded_ha"), "inr"))


@query("p22_headroom_deficit", "select date, dam, round(storage - 2.5, 4) as deficit_bcm, round(100 * (storage - 2.5) / 6, 4) as deficit_pct, round((storage - 2.5) / (80000 * 0.028316846592::double * 86400 / 1e9), 4) as days from dam_daily")
def p22(spark, sf):
    d = dam_daily(spark, sf).select("date", "dam", *P.headroom_deficit("storage", F.lit(2.5), F.lit(6.0)))
    return d.select("date", "dam", r4("deficit_bcm", "deficit_bcm"), r4("deficit_pct", "deficit_pct"), r4(P.absorbable_days("deficit_bcm", F.lit(80000.0)), "days"))


@query("p23_label_events", "select zone, window_start, (fraction > 0.02)::int as wet_event from panel")
def p23(spark, sf):
    from .base import panel

    return P.label_events(panel(spark, sf)).select("zone", "window_start", "wet_event")


NAMES = ["Firozpur", " Ferozepore ", "Tarn  Taran Sahib", "Fazilka", "Mohali", "Elsewhere"]


@query("p24_canonical_zone", "select * from (values ('Firozpur', 'Firozpur', 'Firozpur'), (' Ferozepore ', 'Firozpur', 'Firozpur'), ('Tarn  Taran Sahib', 'Tarn Taran', 'Tarn Taran'), ('Fazilka', 'Fazilka', 'Firozpur'), ('Mohali', 'Sahibzada Ajit Singh Nagar', 'Sahibzada Ajit Singh Nagar'), ('Elsewhere', 'Elsewhere', 'Elsewhere')) v(name, zone, merged) union all select n_name, n_name, n_name from nation")
def p24(spark, sf):
    n = inline(spark, [(x,) for x in NAMES], "name string").union(table(spark, sf, "nation").select("n_name"))
    return n.select("name", P.canonical_zone("name").alias("zone"), P.merged_zone("name").alias("merged"))


@query(
    "p25_normalize_subzone",
    """select s_suppkey, case s_suppkey % 5 when 0 then s_name || '-I' when 1 then s_name || '-II' when 2 then s_name || '-IX' when 3 then s_name else s_name || ' (East)' end as subzone from supplier
    union all select * from (values (-1, 'Amritsar-I'), (-2, 'Amritsar-II'), (-3, 'Rampura Phul')) v""",
)
def p25(spark, sf):
    name = "case s_suppkey % 5 when 0 then s_name || ' -I' when 1 then s_name || '- Ii' when 2 then s_name || ' ix ' when 3 then s_name else s_name || ' (East)' end as name"
    n = table(spark, sf, "supplier").selectExpr("s_suppkey", name).union(inline(spark, [(-1, "Amritsar -I"), (-2, "Amritsar- Ii"), (-3, "Rampura Phul")], "s_suppkey long, name string"))
    return n.select("s_suppkey", P.normalize_subzone("name").alias("subzone"))


@query("p26_slug", "select distinct p_name, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g') as slug from part")
def p26(spark, sf):
    return table(spark, sf, "part").select("p_name", P.slug("p_name").alias("slug")).distinct()


@query(
    "p27_fold_of",
    """select s_suppkey, case s_suppkey % 6 when 0 then 'sutlej' when 1 then 'sutlej' when 2 then 'ravi_beas' end as fold from supplier""",
)
def p27(spark, sf):
    names = ", ".join(f"'{x}'" for x in NAMES)
    n = table(spark, sf, "supplier").selectExpr("s_suppkey", f"array({names})[s_suppkey % 6] as name")
    return n.select("s_suppkey", P.fold_of("name").alias("fold"))
