"""Queries of the series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverlens.functions import scalars as P
from riverlens.functions.calendar import assign_window, season_windows
from riverlens.operators import ranking as T
from riverlens.operators import series as S

from .base import VIEWS, daily_box, dam_daily, hourly, inline, panel, query, r4, scores, table

DAMS = ("1_urgent", "2_high", "3_medium", "4_not_specified", "5_low")
VIEWS["wet95"] = "select quantile_cont(punjab_mm, 0.95) as threshold from daily_box where year(date) between 1995 and 1998 and strftime(date, '%m-%d') between '06-01' and '09-30' and punjab_mm >= 1"
VIEWS["indices"] = """select year(date)::int as year, count(*) filter (where punjab_mm >= threshold) as heavy_days, max(s5) as rx5day, sum(punjab_mm) as total from (
  select *, case when count(punjab_mm) over w = 5 then sum(punjab_mm) over w end as s5 from daily_box where strftime(date, '%m-%d') between '06-01' and '09-30' window w as (partition by year(date) order by date rows between 4 preceding and current row)) cross join wet95 group by 1"""
VIEWS["res_windows"] = """select w.window_start, dam, mean_storage, delta_storage from season_windows w cross join (select distinct dam from dam_daily) left join (
  select window_start, dam, avg(storage) as mean_storage, arg_max(storage, date) - arg_min(storage, date) as delta_storage from dam_daily join season_windows on date >= window_start and date < window_end where storage is not null group by 1, 2) using (window_start, dam)"""
VIEWS["area_hours"] = "select hour, sum(mm * cos(radians(lat))) / sum(cos(radians(lat))) as mm from hourly group by 1"


def windows(spark):
    return season_windows(spark, range(1995, 2002))


def threshold(spark, sf):
    return S.wet_threshold(daily_box(spark, sf), (1995, 1998), "punjab_mm")


def indices(spark, sf):
    return S.annual_indices(daily_box(spark, sf), "punjab_mm", threshold(spark, sf))


def res_windows(spark, sf):
    d = dam_daily(spark, sf)
    return S.reservoir_windows(d, windows(spark), d)


@query("a15_window_sum", "select w.window_start, sum(punjab_mm) as punjab_mm, count(punjab_mm) as days from season_windows w left join daily_box on date >= window_start and date < window_end group by 1")
def a15(spark, sf):
    return S.window_sum(daily_box(spark, sf), windows(spark), "punjab_mm")


LAG = "(select sum(upstream_mm) from daily_box where date >= w.window_start - {k} * n and date < w.window_end - {k} * n)"


@query("a16_window_with_lags", "select window_start, (select sum(upstream_mm) from daily_box where date >= window_start and date < window_end) as upstream_mm_lag0, (select sum(upstream_mm) from daily_box where date >= window_start - n and date < window_end - n) as upstream_mm_lag1, (select sum(upstream_mm) from daily_box where date >= window_start - 2 * n and date < window_end - 2 * n) as upstream_mm_lag2 from (select *, (window_end - window_start)::int as n from season_windows) w")
def a16(spark, sf):
    return S.window_with_lags(daily_box(spark, sf), windows(spark), "upstream_mm")


@query("a17_reservoir_windows", "select window_start, dam, round(mean_storage, 4) as mean_storage, round(delta_storage, 4) as delta_storage from res_windows")
def a17(spark, sf):
    return res_windows(spark, sf).select("window_start", "dam", r4("mean_storage", "mean_storage"), r4("delta_storage", "delta_storage"))


PIV = ", ".join(f"round(avg(mean_storage) filter (where regexp_replace(lower(dam), '[^a-z0-9]+', '_', 'g') = '{d}'), 4) as \"{d}_mean\", round(avg(delta_storage) filter (where regexp_replace(lower(dam), '[^a-z0-9]+', '_', 'g') = '{d}'), 4) as \"{d}_delta\"" for d in DAMS)


@query("a18_pivot_reservoirs", f"select window_start, {PIV} from res_windows group by 1")
def a18(spark, sf):
    w = S.pivot_reservoirs(res_windows(spark, sf), list(DAMS))
    return w.select("window_start", *(r4(c, c) for c in w.columns if c != "window_start"))


@query("a19_area_mean", "select hour, round(mm, 4) as mm from area_hours")
def a19(spark, sf):
    return S.area_mean(hourly(spark, sf)).select("hour", r4("mm", "mm"))


@query(
    "a20_window_intensity",
    """with h as (select *, (date '2024-01-01' + ((dayofmonth(hour) - 1) // 5 * 5)::int)::date as window_start from area_hours),
    s as (select *, sum(mm) over (partition by window_start order by hour rows between 2 preceding and current row) as s3, sum(mm) over (partition by window_start order by hour rows between 23 preceding and current row) as s24,
      row_number() over (partition by window_start order by hour) as i, count(*) over (partition by window_start) as n from h)
    select window_start, round(max(s3) filter (where i >= least(3, n)), 4) as max3h, round(max(s24) filter (where i >= least(24, n)), 4) as max24h, count(*) filter (where mm >= 5) as hours5 from s group by 1""",
)
def a20(spark, sf):
    h = S.area_mean(hourly(spark, sf)).withColumn("window_start", F.expr("date_add(date '2024-01-01', cast((dayofmonth(hour) - 1) div 5 * 5 as int))"))
    return S.window_intensity(h).select("window_start", r4("max3h", "max3h"), r4("max24h", "max24h"), "hours5")


@query("a21_wet_threshold", "select round(threshold, 4) as threshold from wet95")
def a21(spark, sf):
    return threshold(spark, sf).select(r4("threshold", "threshold"))


@query("a22_annual_indices", "select * from indices")
def a22(spark, sf):
    return indices(spark, sf)


@query(
    "a23_same_day_band",
    """with t as (select date from daily_box where year(date) = 2000), p as (select strftime(date, '%m-%d') as md, quantile_cont(punjab_mm, 0.25) as q25, quantile_cont(punjab_mm, 0.5) as q50, quantile_cont(punjab_mm, 0.75) as q75, count(punjab_mm) as n from daily_box where year(date) < 2000 group by 1)
    select date, round(q25, 4) as q25, round(q50, 4) as q50, round(q75, 4) as q75, n from t left join p on strftime(date, '%m-%d') = md""",
)
def a23(spark, sf):
    d = daily_box(spark, sf)
    b = S.same_day_band(d, d.where("year(date) = 2000"), "punjab_mm")
    return b.select("date", *(r4(c, c) for c in ("q25", "q50", "q75")), "n")


VIEWS["curve"] = """with c as (select distinct dam from dam_daily), g as (select dam, date_diff('day', make_date(year(date), 6, 1), date)::int as sday, quantile_cont(storage, 0.25) as q25, quantile_cont(storage, 0.5) as q50, quantile_cont(storage, 0.75) as q75,
  count(distinct year(date)) as n_years, count(*) as n_obs from dam_daily where year(date) between 1995 and 1999 and strftime(date, '%m-%d') between '06-01' and '09-30' and storage is not null group by 1, 2)
  select c.dam, s.sday::int as sday, q25, q50, q75, coalesce(n_years, 0) as n_years, coalesce(n_obs, 0) as n_obs from c cross join range(122) s(sday) left join g on g.dam = c.dam and g.sday = s.sday"""


@query("a24_fill_curve", "select dam, sday, round(q25, 4) as q25, round(q50, 4) as q50, round(q75, 4) as q75, n_years, n_obs from curve")
def a24(spark, sf):
    c = S.fill_curve(dam_daily(spark, sf), (1995, 1999))
    return c.select("dam", "sday", *(r4(x, x) for x in ("q25", "q50", "q75")), "n_years", "n_obs")


# cited points: the readings of every seventh day; targets: all days of the dam's table
VIEWS["cited"] = "select dam, date, storage from dam_daily where storage is not null and date_diff('day', date '1995-01-01', date) % 7 = 0"
VIEWS["bracket"] = """select d.dam, d.date, a.date as da, a.storage as sa, b.date as db, b.storage as sb from dam_daily d
  asof left join cited a on a.dam = d.dam and a.date <= d.date asof left join cited b on b.dam = d.dam and b.date >= d.date"""
LINE = "case when da = db then sa else sa + (sb - sa) * date_diff('day', da, date) / date_diff('day', da, db) end"


def cited(spark, sf):
    return dam_daily(spark, sf).where("storage is not null and datediff(date, date '1995-01-01') % 7 = 0").select("dam", "date", "storage")


@query("w9_interpolate", f"select dam, date, round({LINE}, 4) as storage from bracket")
def w9(spark, sf):
    return S.interpolate(cited(spark, sf), dam_daily(spark, sf).select("dam", "date"), "date", "storage", ("dam",)).select("dam", "date", r4("storage", "storage"))


@query("j12_basis_for", "select dam, date, da as before, db as after, date_diff('day', da, db)::int as gap, case when da = db then 'cited' when da is not null and db is not null then 'interpolated' else 'none' end as basis from bracket")
def j12(spark, sf):
    return S.basis_for(dam_daily(spark, sf).select("dam", "date"), cited(spark, sf), ("dam",))


@query(
    "a28_headroom_table",
    f"""select b.dam, b.date, round(coalesce(d.storage, {LINE.replace("date)", "b.date)")}), 4) as storage, round(q50, 4) as median, round(coalesce(d.storage, {LINE.replace("date)", "b.date)")}) - q50, 4) as deficit_bcm,
    round(100 * (coalesce(d.storage, {LINE.replace("date)", "b.date)")}) - q50) / 6, 4) as deficit_pct, case when d.storage is not null then 'dense' when da = db then 'cited' when da is not null and db is not null then 'interpolated' else 'none' end as basis
    from bracket b join dam_daily d on d.dam = b.dam and d.date = b.date left join curve c on c.dam = b.dam and c.sday = date_diff('day', make_date(year(b.date), 6, 1), b.date)
    where year(b.date) = 2000 and strftime(b.date, '%m-%d') between '06-01' and '09-30'""",
)
def a28(spark, sf):
    h = S.headroom_table(dam_daily(spark, sf), cited(spark, sf), 2000, (1995, 1999), 6.0)
    return h.select("dam", "date", *(r4(c, c) for c in ("storage", "median", "deficit_bcm", "deficit_pct")), "basis")


@query(
    "w10_rating",
    """with p as (select dam, level, avg(storage) as storage from dam_daily where storage is not null and dayofmonth(date) = 1 group by 1, 2), t as (select distinct dam, (300 + dayofmonth(date) * 2)::double as level from dam_daily),
    b as (select t.dam, t.level, a.level as la, a.storage as sa, b.level as lb, b.storage as sb from t asof left join p a on a.dam = t.dam and a.level <= t.level asof left join p b on b.dam = t.dam and b.level >= t.level)
    select dam, level, round(case when la is null then sb when lb is null or la = lb then sa else sa + (sb - sa) * (level - la) / (lb - la) end, 4) as storage from b""",
)
def w10(spark, sf):
    d = dam_daily(spark, sf)
    pairs = d.where("dayofmonth(date) = 1 and storage is not null")
    return S.rating(d.selectExpr("dam", "cast(300 + dayofmonth(date) * 2 as double) as level").distinct(), pairs).select("dam", "level", r4("storage", "storage"))


@query(
    "w11_rolling",
    """select date, case when count(punjab_mm) over p = 5 then sum(punjab_mm) over p end as moving_sum, round(case when count(punjab_mm) over m >= 2 then avg(punjab_mm) over m end, 4) as centred_mean from daily_box
    where date is not null window p as (order by date rows between 4 preceding and current row), m as (order by date rows between 3 preceding and 3 following)""",
)
def w11(spark, sf):
    return S.rolling(daily_box(spark, sf).where("date is not null"), "date", "punjab_mm").select("date", "moving_sum", r4("centred_mean", "centred_mean"))


@query("w12_dedupe", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by (o_orderstatus = 'P')::int, o_orderdate, o_orderkey) as rn from orders) where rn = 1")
def w12(spark, sf):
    return T.dedupe(table(spark, sf, "orders"), ["o_custkey"], F.expr("o_orderstatus = 'P'"), "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("w13_contiguous_start", "select 1997 as start")
def w13(spark, sf):
    y = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).where("year <> 1996")
    return S.contiguous_start(y)


@query("w14_lag1_autocorr", "with d as (select year, total - avg(total) over () as d from indices), p as (select d, lag(d) over (order by year) as p from d) select 'punjab' as series, round(sum(d * p) / sum(d * d), 4) as r1, count(*) as n from p")
def w14(spark, sf):
    s = indices(spark, sf).withColumn("series", F.lit("punjab"))
    return S.lag1_autocorr(s, "year", "total").select("series", r4("r1", "r1"), "n")


@query("w1_add_lags", "select zone, window_start, round(lag(fraction) over w, 4) as fraction_lag1, round(lag(fraction, 2) over w, 4) as fraction_lag2 from panel window w as (partition by zone order by window_start)")
def w1(spark, sf):
    return S.add_lags(panel(spark, sf), "fraction", 2).select("zone", "window_start", r4("fraction_lag1", "fraction_lag1"), r4("fraction_lag2", "fraction_lag2"))


@query("w2_assemble", "select zone, window_start, round(lag(fraction) over (partition by zone order by window_start), 4) as antecedent, (row_number() over (partition by zone, year order by window_start) - 1)::int as week from panel")
def w2(spark, sf):
    return S.assemble(panel(spark, sf)).select("zone", "window_start", r4("antecedent", "antecedent"), "week")


@query("w3_risk_rank", "select zone, window_start, rank() over (partition by window_start order by prob desc)::int as risk_rank from scores")
def w3(spark, sf):
    return S.risk_rank(scores(spark, sf)).select("zone", "window_start", "risk_rank")


@query("w4_peak_rank", "with g as (select zone, max(prob) as peak, arg_max(window_start, struct_pack(a := prob, b := -date_diff('day', date '1970-01-01', window_start))) as peak_window from scores group by 1) select zone, round(peak, 4) as peak, peak_window, row_number() over (order by g.peak desc, zone)::int as rank from g")
def w4(spark, sf):
    return S.peak_rank(scores(spark, sf)).withColumn("peak", r4("peak"))


@query("u4_append_record", "select date, case when date >= date '1998-01-01' then upstream_mm else punjab_mm end as mm from daily_box where date is not null")
def u4(spark, sf):
    d = daily_box(spark, sf).where("date is not null")
    return T.append_record(d.where("date < date '1998-06-01'").selectExpr("date", "punjab_mm as mm"), d.where("date >= date '1998-01-01'").selectExpr("date", "upstream_mm as mm"), "date")


@query("j9_coalesce_sources", "select date, coalesce(punjab_mm, upstream_mm) as mm, (case when punjab_mm is not null then 0 when upstream_mm is not null then 1 end)::int as source from daily_box where date is not null")
def j9(spark, sf):
    d = daily_box(spark, sf).where("date is not null")
    return T.coalesce_sources(["date"], "mm", d.selectExpr("date", "punjab_mm as mm"), d.selectExpr("date", "upstream_mm as mm"))
