"""Queries of the spatial operators, the rankings and the set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverlens.functions import quality as Q
from riverlens.functions import scalars as P
from riverlens.functions.calendar import season_windows
from riverlens.operators import panels as L
from riverlens.operators import ranking as T
from riverlens.operators import series as S
from riverlens.operators import spatial as N
from riverlens.operators import zonal as Z
from riverlens.sources.tables import read_polygons

from .base import VIEWS, daily_box, inline, masks, official, panel, px_pass, px_static, query, r4, scenes, scores, table
from .q_scalars import px_area
from .q_series import DAMS, res_windows
from .q_sources import geojson
from .q_zonal import season_zone, union_px

VIEWS["wet_px"] = 'select pixel, "row", col, zone from union_px where wet'


def wet_px(spark, sf):
    return union_px(spark, sf).where("wet").select("pixel", "row", "col", "zone")


@query(
    "j1_assemble_panel",
    f"""with r as (select w.window_start, sum(punjab_mm) as rain from season_windows w left join daily_box on date >= window_start and date < window_end group by 1),
    s as (select window_start, avg(mean_storage) filter (where dam = '1-URGENT') as st from res_windows group by 1)
    select zone, window_start, round(fraction, 4) as fraction, rain, round(st, 4) as st from panel left join r using (window_start) left join s using (window_start)""",
)
def j1(spark, sf):
    w = season_windows(spark, range(1995, 2002))
    rain = S.window_sum(daily_box(spark, sf), w, "punjab_mm").select("window_start", F.col("punjab_mm").alias("rain"))
    res = S.pivot_reservoirs(res_windows(spark, sf), list(DAMS)).select("window_start", F.col("1_urgent_mean").alias("st"))
    return L.assemble_panel(panel(spark, sf), rain, res).select("zone", "window_start", r4("fraction", "fraction"), "rain", r4("st", "st"))


@query("j2_add_prior", "select p.zone, window_start, seasons_1pct as prior_seasons_1pct, round(max_fraction, 4) as prior_max_fraction from panel p left join (select 'NATION_' || zone as zone, seasons_1pct, max_fraction from victims) v using (zone)")
def j2(spark, sf):
    v = Z.repeat_victims(season_zone(spark, sf)).withColumn("zone", F.concat(F.lit("NATION_"), F.col("zone").cast("string")))
    return L.add_prior(panel(spark, sf), v, ["seasons_1pct", "max_fraction"]).select("zone", "window_start", "prior_seasons_1pct", r4("prior_max_fraction", "prior_max_fraction"))


@query("j3_flooded_fraction", "select zone, window_start, round(fraction, 4) as fraction from panel")
def j3(spark, sf):
    p = panel(spark, sf)
    return L.flooded_fraction(p.select("zone", "window_start", "flooded_ha"), p.select("zone", "area_ha").distinct()).select("zone", "window_start", r4("fraction", "fraction"))


@query(
    "j4_label_pixels",
    """select pixel, (case when "row" < 3 and col >= 16 and not (col in (20, 21) and "row" = 1) then 1 when "row" >= 3 and "row" < 60 and (col < 8 or col >= 24) then 2
    when "row" >= 3 and "row" < 60 then 3 when "row" < 3 and col < 16 then 4 else 0 end)::int as label from px_static""",
)
def j4(spark, sf):
    px = px_static(spark, sf).selectExpr("pixel", "col + 0.5d as x", "row + 0.5d as y")
    return N.label_pixels(px, read_polygons(spark, geojson(spark))).select("pixel", "label")


@query(
    "j5_assign_parent",
    """with p as (select pixel % 6 as sub, case when pixel % 5 < 3 then zone end as zone, m2 from px_area where pixel % 6 <> 5 or pixel % 5 >= 3),
    g as (select sub, zone, sum(m2) as a, sum(sum(m2)) over (partition by sub) as total from p group by 1, 2),
    i as (select *, sum(a) over (partition by sub) as inside, row_number() over (partition by sub order by a desc, zone) as rn from g where zone is not null)
    select sub, zone as parent, round(a / total, 4) as share from i where rn = 1 and inside >= 0.5 * total""",
)
def j5(spark, sf):
    p = px_area(spark, sf).where("pixel % 6 <> 5 or pixel % 5 >= 3").selectExpr("pixel % 6 as sub", "if(pixel % 5 < 3, zone, null) as zone", "m2")
    return N.assign_parent(p).withColumn("share", r4("share"))


@query("j6_regrid_nearest", 'select d."row", d.col, s.elev from (select distinct "row" // 2 as "row", col // 2 as col from px_static) d left join px_static s on s."row" = d."row" * 2 + 1 and s.col = d.col * 2 + 1')
def j6(spark, sf):
    s = px_static(spark, sf)
    return N.regrid_nearest(s.selectExpr("row div 2 as row", "col div 2 as col").distinct(), s, "elev", 2.0)


@query("j7_regrid_average", 'select "row" // 4 as "row", col // 4 as col, round(avg(elev), 4) as elev from px_static group by 1, 2')
def j7(spark, sf):
    return N.regrid_average(px_static(spark, sf), "elev", 4).withColumn("elev", r4("elev"))


VIEWS["shifted"] = """select "row", col, sum(v) as pop from (select "row" + i as "row", col + j as col, pop * (case when i = 1 then 0.25::double else 0.75::double end) * (case when j = 1 then 0.5::double else 0.5::double end) as v
  from px_static cross join (values (0), (1)) a(i) cross join (values (0), (1)) b(j)) group by 1, 2"""


@query("j8_regrid_population", 'select "row", col, round(pop, 4) as pop from shifted')
def j8(spark, sf):
    return N.regrid_population(px_static(spark, sf), "pop", 0.5, 0.25).withColumn("pop", r4("pop"))


@query("q4_check_conservation", "select round((select sum(pop) from px_static), 4) as before, round((select sum(pop) from shifted), 4) as after, 1.0::double as ratio")
def q4(spark, sf):
    s = px_static(spark, sf)
    c = Q.check_conservation(s, N.regrid_population(s, "pop", 0.5, 0.25), "pop")
    return c.select(*(r4(x, x) for x in ("before", "after", "ratio")))


@query("j10_earliest_clear", "select user_id as point, min(ts) filter (where event_type = 'view') as date, arg_min(value, ts) filter (where event_type = 'view') as value from events group by 1")
def j10(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id as point", "ts as date", "value", "event_type = 'view' as usable")
    return N.earliest_clear(e.select("point").distinct(), e)


@query("j11_count_or_zero", "select k.name, coalesce(n, 0)::bigint as n from (select n_name as name, n_nationkey as i from nation union all select * from (values (' nation_1 ', 1), ('nowhere', -1)) v) k left join (select c_nationkey as i, count(*) as n from customer where c_nationkey % 3 <> 0 group by 1) c using (i)")
def j11(spark, sf):
    n = table(spark, sf, "nation")
    dim = table(spark, sf, "customer").where("c_nationkey % 3 <> 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"))
    keys = n.select(F.col("n_name").alias("name")).union(inline(spark, [(" nation_1 ",), ("nowhere",)], "name string"))
    return N.count_or_zero(keys, dim, "name", "n")


@query("j13_best_common_orbit", "select orbit, count(*) filter (where phase = 'pre') as pre, count(*) filter (where phase = 'wet') as wet from scenes group by 1 having count(*) filter (where phase = 'pre') > 0 and count(*) filter (where phase = 'wet') > 0 order by least(count(*) filter (where phase = 'pre'), count(*) filter (where phase = 'wet')) desc, count(*) desc, orbit limit 1")
def j13(spark, sf):
    return N.best_common_orbit(scenes(spark, sf))


@query("n1_sieve", 'with recursive e as (select a.pixel as a, b.pixel as b from wet_px a join wet_px b on abs(a."row" - b."row") <= 1 and abs(a.col - b.col) <= 1), r as (select pixel as p, pixel as q from wet_px union select p, b from r join e on q = a), l as (select p, min(q) as label from r group by 1) select p as pixel from l where label in (select label from l group by 1 having count(*) >= 3)')
def n1(spark, sf):
    return N.sieve(wet_px(spark, sf), 3).select("pixel")


@query("n2_buffer", 'select distinct a."row" + i as "row", a.col + j as col from wet_px a cross join (values (-1), (0), (1)) x(i) cross join (values (-1), (0), (1)) y(j)')
def n2(spark, sf):
    return N.buffer(wet_px(spark, sf))


@query(
    "n3_slope",
    """with g as (select s.pixel, s.elev, l.elev as l, r.elev as r, u.elev as u, d.elev as d from px_static s left join px_static l on l."row" = s."row" and l.col = s.col - 1 left join px_static r on r."row" = s."row" and r.col = s.col + 1
      left join px_static u on u.col = s.col and u."row" = s."row" - 1 left join px_static d on d.col = s.col and d."row" = s."row" + 1),
    h as (select pixel, case when l is not null and r is not null then (r - l) / 180 when r is not null then (r - elev) / 90 when l is not null then (elev - l) / 90 else 0 end as gx,
      case when u is not null and d is not null then (d - u) / 180 when d is not null then (d - elev) / 90 when u is not null then (elev - u) / 90 else 0 end as gy from g)
    select pixel, round(degrees(atan(sqrt(gx * gx + gy * gy))), 4) as slope from h""",
)
def n3(spark, sf):
    return N.slope(px_static(spark, sf), 90.0).select("pixel", r4("slope", "slope"))


@query("n4_or_pool", 'select "row" // 4 as "row", col // 4 as col, bool_or(wet) as wet from union_px group by 1, 2')
def n4(spark, sf):
    return N.or_pool(union_px(spark, sf), 4)


@query("n5_focal_median", 'select a.pixel, round(median(b.elev), 4) as median from px_static a join px_static b on (a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col) <= 2.25 group by 1')
def n5(spark, sf):
    return N.focal_median(px_static(spark, sf), 1.5).select("pixel", r4("median", "median"))


@query("t1_state_totals", "select n_name, sum(s_acctbal * 100)::bigint as total, n_nationkey as ord from nation join supplier on s_nationkey = n_nationkey group by 1, 3")
def t1(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("cents", F.expr("cast(round(s_acctbal * 100) as bigint)"))
    return T.state_totals(s, "n_name", "cents", "n_nationkey")


@query("t2_zone_rows", "select zone, round(flooded_ha / 100, 4) as km2, flooded_ha / 100 >= 0.02 as flagged from zone_ha")
def t2(spark, sf):
    return T.zone_rows(Z.zone_area(union_px(spark, sf)), 0.02).withColumn("km2", r4("km2"))


@query("p16_render_alerts", "select zone, lang, replace(replace(template, '{zone}', zone::varchar), '{km2}', printf('%.1f', flooded_ha)) as text from zone_ha cross join (values ('en', 'Water in {zone}: {km2} km2'), ('pa', 'Harh {zone} vich: {km2}'), ('hi', 'Baadh {zone}: {km2}')) t(lang, template) where flooded_ha / 100 >= 0.02")
def p16(spark, sf):
    flagged = T.zone_rows(Z.zone_area(union_px(spark, sf)), 0.02).where("flagged").withColumn("km2", F.col("km2") * 100)
    texts = inline(spark, [("en", "Water in {zone}: {km2} km2"), ("pa", "Harh {zone} vich: {km2}"), ("hi", "Baadh {zone}: {km2}")], "lang string, template string")
    return P.render_alerts(flagged, texts, ["en", "pa", "hi"])


@query("t4_top_per_group", "select orbit, pixel, ts, rn::int as rn from (select *, row_number() over (partition by orbit order by ts desc, pixel, power, phase, zone) as rn from scenes) where rn <= 2")
def t4(spark, sf):
    return T.top_per_group(scenes(spark, sf), 2, "orbit", F.desc("ts"), "pixel", F.asc_nulls_last("power"), "phase", "zone").select("orbit", "pixel", "ts", "rn")


@query("t5_nowcast_order", "select window_start, row_number() over (partition by window_start order by coalesce(-prob, 1), -coalesce(truth * 100, 0), zone)::int as place, zone, round(prob, 4) as p, round(truth * 100, 4) as km2 from scores")
def t5(spark, sf):
    s = scores(spark, sf).selectExpr("window_start", "zone", "prob as p", "truth * 100 as km2")
    return T.nowcast_places(s, ["window_start"]).select("window_start", "place", "zone", r4("p", "p"), r4("km2", "km2"))


@query("u1_union_strata", "with w as (select pixel from px_static where perm), f as (select pixel from px_static where crop and pixel not in (select pixel from w)) select pixel, 'water' as stratum from w union all select pixel, 'crop' from f union all select pixel, 'rest' from px_static where pixel not in (select pixel from w) and pixel not in (select pixel from f)")
def u1(spark, sf):
    s = px_static(spark, sf)
    return T.union_strata(("water", s.where("perm")), ("crop", s.where("crop")), ("rest", s))


@query("u2_minus", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def u2(spark, sf):
    return T.minus(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("u3_mask_sets", 'select id, \'both\' as "set" from masks where a and b union all select id, \'either\' from masks where a or b union all select id, \'one\' from masks where a <> b')
def u3(spark, sf):
    return T.mask_sets(masks(spark, sf), "a", "b")


@query(
    "a26_network_totals",
    """with s as (select n_name as state, o_orderstatus as kind, o_orderkey % 3 = 0 as live from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)
    select state, kind, count(*) as stations, count(*) filter (where live) as live from s group by 1, 2 union all select state, 'Total', count(*), count(*) filter (where live) from s group by 1
    union all select 'Total', kind, count(*), count(*) filter (where live) from s group by 2 union all select 'Total', 'Total', count(*), count(*) filter (where live) from s""",
)
def a26(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return Z.network_totals(o.select(F.col("n_name").alias("state"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 3 == 0).alias("live")))


@query(
    "q1_check_totals",
    """with p as (select n_name as state, count(*) filter (where o_orderstatus = 'P') as p, count(*) filter (where o_orderstatus <> 'P') as rest, count(*) as total from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1)
    select 'bad' as key, 'row' as rule, 3.0::double as found, 4.0::double as declared union all select 'Total', 'total', (sum(total) + 4)::double, 10.0::double from p""",
)
def q1(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    t = o.groupBy(F.col("n_name").alias("state")).agg(F.count_if(F.expr("o_orderstatus = 'P'")).alias("p"), F.count_if(F.expr("o_orderstatus <> 'P'")).alias("rest"), F.count("*").alias("total"))
    return Q.check_totals(t.union(inline(spark, [("bad", 1, 2, 4), ("Total", 0, 0, 10)], "state string, p long, rest long, total long")), ["p", "rest"], "total", "state")


@query(
    "q2_check_history",
    """with h as (select p_partkey, case p_size % 5 when 0 then 'what' when 1 then 'lives_lost' when 2 then 'crop_damage_value' else 'area_affected' end as metric,
      case p_partkey % 4 when 0 then 'acre' when 1 then 'Mha' when 2 then 'count' else 'crore_inr' end as unit, case p_partkey % 7 when 0 then 'x' when 1 then '-' || p_size else p_size::varchar end as value from part)
    select metric, unit, value, 'unknown metric' as rule from h where metric = 'what' union all select metric, unit, value, 'unknown unit' from h where unit = 'acre'
    union all select metric, unit, value, 'not a number' from h where value = 'x' union all select metric, unit, value, 'negative' from h where value like '-%'""",
)
def q2(spark, sf):
    h = table(spark, sf, "part").selectExpr(
        "case p_size % 5 when 0 then 'what' when 1 then 'lives_lost' when 2 then 'crop_damage_value' else 'area_affected' end as metric",
        "case p_partkey % 4 when 0 then 'acre' when 1 then 'Mha' when 2 then 'count' else 'crore_inr' end as unit",
        "case p_partkey % 7 when 0 then 'x' when 1 then concat('-', p_size) else string(p_size) end as value",
    )
    return Q.check_history(h)


@query("q3_check_keys", "select n_name as zone from nation where n_name not in (select zone from official where theirs is not null)")
def q3(spark, sf):
    return Q.check_keys(table(spark, sf, "nation").select(F.col("n_name").alias("zone")), official(spark, sf).where("theirs is not null"), "zone")
