"""Queries of the calendar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverlens.functions import calendar as K

from .base import VIEWS, inline, query, table

VIEWS["order_windows"] = """select y.year, k::int as idx, (s + (k * 10)::int)::date as window_start, least((s + (k * 10 + 10)::int)::date, make_date(y.year, 9, 30)) as window_end
  from (select distinct year(o_orderdate)::int as year, make_date(year(o_orderdate), 6, 15) as s from orders) y cross join range(11) r(k)"""


def years(spark, sf):
    return table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()


@query("k1_season_windows", "select year, idx, window_start, window_end from order_windows")
def k1(spark, sf):
    return K.season_windows(spark, years(spark, sf))


@query(
    "k2_run_manifest",
    """select year, window_start, window_end, make_date(year, 3, 1) as baseline_start, make_date(year, 5, 31) as baseline_end,
    'wet_' || strftime(window_start, '%Y%m%d') || '_' || strftime(window_end, '%Y%m%d') as export_key from order_windows""",
)
def k2(spark, sf):
    return K.run_manifest(spark, years(spark, sf))


@query("k3_assign_window", "select o_orderkey, w.window_start from orders left join season_windows w on o_orderdate::date >= window_start and o_orderdate::date < window_end")
def k3(spark, sf):
    return K.assign_window(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day").select("o_orderkey", "window_start")


@query("k4_filter_days", "select pixel, day, wet from px_pass where day between date '2024-01-10' and date '2024-01-20'")
def k4(spark, sf):
    from .base import px_pass

    return K.filter_days(px_pass(spark, sf), "2024-01-10", "2024-01-20").select("pixel", "day", "wet")


@query("k5_day_offset", "select o_orderkey, date_diff('day', date '1998-06-01', o_orderdate::date)::int as day_offset from orders")
def k5(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", K.day_offset(F.to_date("o_orderdate"), "1998-06-01").alias("day_offset"))


@query("k6_season_day", "select o_orderkey, date_diff('day', make_date(year(o_orderdate), 6, 1), o_orderdate::date)::int as season_day from orders")
def k6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", K.season_day(F.to_date("o_orderdate")).alias("season_day"))


@query("k7_in_season", "select year(o_orderdate)::int as year, count(*) filter (where strftime(o_orderdate, '%m-%d') between '06-01' and '09-30') as in_season, count(*) as n from orders group by 1")
def k7(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count_if(K.in_season("o_orderdate")).alias("in_season"), F.count("*").alias("n"))


@query("k8_core_season", "select window_start, strftime(window_start, '%m-%d') >= '07-25' as core from order_windows")
def k8(spark, sf):
    return K.season_windows(spark, years(spark, sf)).select("window_start", K.core_season("window_start").alias("core"))


@query("k9_calendar", "select unnest(generate_series(min(o_orderdate)::date, max(o_orderdate)::date - 1, interval 1 day))::date as day from orders")
def k9(spark, sf):
    """Every day from the first order to the one before the last, also those without orders."""
    ends = table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")).first()
    return K.calendar(spark, str(ends.a), str(ends.b))


@query(
    "k10_resolve_window",
    """with d as (select distinct o_orderdate::date as day from orders),
    i as (select *, make_date(year(day), 6, 15) as s, case when day < make_date(year(day), 6, 15) then 0 when day >= make_date(year(day), 9, 30) then 10
      else date_diff('day', make_date(year(day), 6, 15), day) // 10 end as k from d)
    select day, case when day < s then 'before' when day >= make_date(year(day), 9, 30) then 'after' else 'in' end as phase, k::int as idx, (s + (k * 10)::int)::date as window_start,
      least((s + (k * 10 + 10)::int)::date, make_date(year(day), 9, 30)) as window_end, case when k >= 1 then (s + (k * 10 - 10)::int)::date end as previous_1,
      case when k >= 2 then (s + (k * 10 - 20)::int)::date end as previous_2, strftime((s + (k * 10)::int)::date, '%m-%d') >= '07-25' as core, make_date(year(day), 7, 25) as active_from from i""",
)
def k10(spark, sf):
    return K.resolve_window(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct())


@query("k11_local_day", "select event_id, (ts + interval 330 minute)::date as local_day from events")
def k11(spark, sf):
    return table(spark, sf, "events").select("event_id", K.local_day("ts").alias("local_day"))


@query(
    "k12_scene_date",
    """select 'E_' || event_id || '_' || upper(strftime(ts, '%d%b%Y')) as scene, ts::date as day,
      case when ts::date between date '2024-01-10' and date '2024-01-19' then 'wet' when ts::date < date '2024-01-05' then 'pre' else 'other' end as class from events
    union all select * from (values ('EOS04_05SEP2025_x', date '2025-09-05', 'other'), ('x_05092025_y', date '2025-09-05', 'other'), ('no date', null, 'undated'), ('99XXX2025', null, 'undated')) v""",
)
def k12(spark, sf):
    named = table(spark, sf, "events").select(F.concat(F.lit("E_"), F.col("event_id"), F.lit("_"), F.upper(F.date_format("ts", "ddMMMyyyy"))).alias("scene"))
    more = inline(spark, [("EOS04_05SEP2025_x",), ("x_05092025_y",), ("no date",), ("99XXX2025",)], "scene string")
    d = named.union(more).withColumn("day", K.scene_date("scene"))
    return d.withColumn("class", K.classify_scene("day", ("2024-01-10", "2024-01-19"), ("2023-12-01", "2024-01-04")))


@query(
    "k13_period_year",
    """select o_orderkey, case o_orderkey % 4 when 0 then y::varchar when 1 then y || '-' || lpad(((y + 1) % 100)::varchar, 2, '0') when 2 then y || '-' || (y + 5) else ' ' || y || ' ' end as period,
      case when o_orderkey % 4 <> 2 then y end as year from (select o_orderkey, year(o_orderdate)::int as y from orders) union all select null, null, null""",
)
def k13(spark, sf):
    y = "year(o_orderdate)"
    period = f"""case o_orderkey % 4 when 0 then string({y}) when 1 then concat({y}, '-', lpad(({y} + 1) % 100, 2, '0')) when 2 then concat({y}, '-', {y} + 5) else concat(' ', {y}, ' ') end as period"""
    p = table(spark, sf, "orders").selectExpr("o_orderkey", period).union(inline(spark, [(None, None)], "o_orderkey long, period string"))
    return p.withColumn("year", K.period_year("period"))


@query(
    "k14_complete_years",
    """with y as (select year(date)::int as year, count(distinct date) as days from daily_box where strftime(date, '%m-%d') between '06-01' and '09-30' group by 1 having count(distinct date) >= 100),
    n as (select *, row_number() over (order by year) as rn, count(*) filter (where year between 1995 and 1998) over () as n from y)
    select year, days, case when n >= 3 then year between 1995 and 1998 else rn <= 30 end as base from n""",
)
def k14(spark, sf):
    from .base import daily_box

    y = K.complete_years(daily_box(spark, sf), least=100)
    base = K.base_years(y, 1995, 1998, least=3).withColumn("base", F.lit(True))
    return y.join(base, "year", "left").select("year", "days", F.coalesce("base", F.lit(False)).alias("base"))
