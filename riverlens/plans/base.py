"""Views on the driver's tables and the register of queries.

Each view stands for a table of observations (pixels, passes, scenes, rain, dams, panels) and exists twice: as a
DataFrame here and as SQL in VIEWS, which the oracle queries put in front of theirs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; the views that its SQL names are put in front of it."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql.replace(", 4)", " + 1e-9, 4)"))
        return f

    return register


def with_views(sql: str) -> str:
    need: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                visit(VIEWS[v])
                need.append(v)

    visit(sql)
    if not need:
        return sql
    head = ", ".join(f"{v} as ({VIEWS[v]})" for v in need)
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {head}, {body[14:]}"
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its times, which carry no zone, become timestamps of the UTC session."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


def r4(c, name: str | None = None) -> Column:
    """Four decimals. The tiny addend, the same in the SQL, keeps values that end in half a unit from
    going up or down by their last bit."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast("double") + F.lit(1e-9), 4)
    return out.alias(name) if name else out


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r4(c) for c in cols})


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


VIEWS: dict[str, str] = {}

VIEWS["px_pass"] = """
select u.pixel, (u.pixel // 32)::bigint as "row", (u.pixel % 32)::bigint as col, (u.pixel % 20 + 1)::bigint as zone, d.day, coalesce(e.wet, false) as wet
from (select distinct user_id as pixel from events) u cross join (select distinct ts::date as day from events) d
left join (select user_id as pixel, ts::date as day, bool_or(event_type = 'error') as wet from events group by all) e using (pixel, day)"""


def px_pass(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("pixel"), F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("wet"))
    seen = e.groupBy("pixel", "day").agg(F.bool_or("wet").alias("wet"))
    grid = e.select("pixel").distinct().crossJoin(e.select("day").distinct())
    out = grid.join(seen, ["pixel", "day"], "left")
    return out.select("pixel", F.expr("pixel div 32").alias("row"), F.expr("pixel % 32").alias("col"), F.expr("pixel % 20 + 1").alias("zone"), "day", F.coalesce("wet", F.lit(False)).alias("wet"))


VIEWS["px_static"] = """
select user_id as pixel, (user_id // 32)::bigint as "row", (user_id % 32)::bigint as col, (user_id % 20 + 1)::bigint as zone,
  user_id % 17 = 0 as perm, user_id % 3 <> 0 as crop, sum(round(value * 100)::bigint)::double / 100 as pop, sum(round(value * 100)::bigint)::double / count(*) / 100 as elev
from events group by user_id"""


def px_static(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("pixel")).agg(F.expr("cast(sum(cast(round(value * 100) as bigint)) as double) / 100").alias("pop"), F.expr("cast(sum(cast(round(value * 100) as bigint)) as double) / count(*) / 100").alias("elev"))
    x = ["pixel", "pixel div 32 as row", "pixel % 32 as col", "pixel % 20 + 1 as zone", "pixel % 17 = 0 as perm", "pixel % 3 <> 0 as crop", "pop", "elev"]
    return e.selectExpr(*x)


VIEWS["scenes"] = """
select l_orderkey as pixel, (l_suppkey % 20 + 1)::bigint as zone, l_returnflag || l_linestatus as orbit, l_shipdate as ts,
  case when l_linenumber % 2 = 1 then 'pre' else 'wet' end as phase, case when l_tax <> 0 then l_discount end as power
from lineitem"""


def scenes(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as pixel", "l_suppkey % 20 + 1 as zone", "concat(l_returnflag, l_linestatus) as orbit", "l_shipdate as ts",
        "if(l_linenumber % 2 = 1, 'pre', 'wet') as phase", "if(l_tax <> 0, l_discount, null) as power",
    )


VIEWS["daily_box"] = """
select l_shipdate::date as date, sum(case when l_returnflag = 'A' then l_quantity end) as punjab_mm,
  sum(case when l_returnflag = 'R' then l_quantity end) as upstream_mm from lineitem group by 1"""


def daily_box(spark, sf) -> DataFrame:
    flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity")))
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(flag("A").alias("punjab_mm"), flag("R").alias("upstream_mm"))


VIEWS["hourly"] = """
select date_trunc('hour', ts) as hour, (user_id % 9)::bigint as point, 29.53::double + (user_id % 9 // 3) * 1.535::double as lat, sum(round(value * 100)::bigint)::double / 10000 as mm
from events group by 1, 2, 3"""


def hourly(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").selectExpr("date_trunc('hour', ts) as hour", "user_id % 9 as point", "29.53d + (user_id % 9 div 3) * 1.535d as lat", "value")
    return e.groupBy("hour", "point", "lat").agg(F.expr("cast(sum(cast(round(value * 100) as bigint)) as double) / 10000").alias("mm"))


VIEWS["dam_daily"] = """
select o_orderdate::date as date, o_orderpriority as dam, 300 + s * 10 as level, case when f then 'ft' else 'm' end as unit, s as storage from (
  select o_orderdate, o_orderpriority, sum(case when o_orderstatus <> 'P' then round(o_totalprice * 100)::bigint end)::double / count(*) filter (where o_orderstatus <> 'P') / 1e7::double as s, bool_or(o_orderstatus = 'F') as f
  from orders group by 1, 2)"""


def dam_daily(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("dam"))
    o = o.agg(F.expr("try_divide(cast(sum(if(o_orderstatus <> 'P', cast(round(o_totalprice * 100) as bigint), null)) as double), count_if(o_orderstatus <> 'P')) / 1e7").alias("storage"), F.bool_or(F.expr("o_orderstatus = 'F'")).alias("f"))
    return o.selectExpr("date", "dam", "300 + storage * 10 as level", "if(f, 'ft', 'm') as unit", "storage")


#: Boxes of each nation by its key: one, two parts (keys that 5 divides) or one with a hole (rest 1 of 4).
VIEWS["nation_boxes"] = """select n_name as zone, part, ring, x0::double as x0, y0::double as y0, x1::double as x1, y1::double as y1 from (
  select n_name, 0 as part, 0 as ring, n_nationkey * 8 as x0, 3 as y0, n_nationkey * 8 + 4 + n_nationkey % 3 as x1, 20 + n_nationkey as y1 from nation
  union all select n_name, 1, 0, n_nationkey * 8, 100, n_nationkey * 8 + 2, 110 from nation where n_nationkey % 5 = 0
  union all select n_name, 0, 1, n_nationkey * 8 + 1, 4, n_nationkey * 8 + 2, 6 from nation where n_nationkey % 4 = 1)"""

VIEWS["season_windows"] = """
select y::int as year, i::int as idx, (make_date(y, 6, 15) + (i * 10)::int)::date as window_start,
  least((make_date(y, 6, 15) + (i * 10 + 10)::int)::date, make_date(y, 9, 30)) as window_end
from (select unnest(range(1995, 2002)) as y) cross join (select unnest(range(0, 11)) as i)"""

VIEWS["panel"] = """
select z.zone, w.year, w.window_start, coalesce(f.flooded, 0) as flooded_ha, z.area_ha, coalesce(f.flooded, 0) / z.area_ha as fraction
from (select n_name as zone, sum(l_quantity) / 100 as area_ha from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1) z
cross join season_windows w
left join (select n_name as zone, year, window_start, sum(case when l_returnflag = 'R' and l_discount >= 0.08 then l_quantity else 0 end) as flooded
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  join season_windows on l_shipdate::date >= window_start and l_shipdate::date < window_end group by all) f using (zone, year, window_start)"""


def panel(spark, sf) -> DataFrame:
    """zone, year, window_start, flooded_ha, area_ha, fraction: every combination is present."""
    from riverlens.functions.calendar import assign_window, season_windows

    zone = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("zone"))
    sup = table(spark, sf, "supplier").join(zone, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "zone")
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", "l_discount", F.to_date("l_shipdate").alias("day"))
    l = l.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    area = l.groupBy("zone").agg((F.sum("l_quantity") / 100).alias("area_ha"))
    windows = season_windows(spark, range(1995, 2002))
    wet = F.when(F.expr("l_returnflag = 'R' and l_discount >= 0.08"), F.col("l_quantity")).otherwise(0.0)
    flooded = assign_window(l, "day").where("window_start is not null").groupBy("zone", "window_start").agg(F.sum(wet).alias("f"))
    full = area.crossJoin(F.broadcast(windows.select("year", "window_start"))).join(flooded, ["zone", "window_start"], "left")
    return full.select("zone", "year", "window_start", F.coalesce("f", F.lit(0.0)).alias("flooded_ha"), "area_ha", (F.coalesce("f", F.lit(0.0)) / F.col("area_ha")).alias("fraction"))


VIEWS["scores"] = """
select zone, year, window_start, case when fraction > q then 1 else 0 end as y, coalesce(ant, 0) / m as prob, fraction as truth, coalesce(ant, 0) as pred from (
  select *, lag(fraction) over (partition by zone order by window_start) as ant, quantile_cont(fraction, 0.9) over () as q, max(fraction) over () as m from panel)"""


def scores(spark, sf) -> DataFrame:
    """Out-of-fold scores of the panel: persistence as probability and as prediction."""
    from pyspark.sql import Window

    p = panel(spark, sf)
    top = p.agg(F.percentile("fraction", F.lit(0.9)).alias("q"), F.max("fraction").alias("m"))
    p = p.withColumn("ant", F.coalesce(F.lag("fraction").over(Window.partitionBy("zone").orderBy("window_start")), F.lit(0.0)))
    return p.crossJoin(F.broadcast(top)).selectExpr("zone", "year", "window_start", "if(fraction > q, 1, 0) as y", "ant / m as prob", "fraction as truth", "ant as pred")


VIEWS["masks"] = """
select vec_id as id, label::bigint as zone, embedding[1] > 0 as a, embedding[2] > 0 as b, embedding[3] > 0 as c, label < 5 as truth, label <> 9 as valid from embeddings"""


def masks(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id as id", "cast(label as bigint) as zone", "embedding[0] > 0 as a", "embedding[1] > 0 as b", "embedding[2] > 0 as c", "label < 5 as truth", "label <> 9 as valid"
    )


VIEWS["official"] = """
select n_name as zone, s.v as ours, case when n_nationkey % 5 <> 4 then c.v end as theirs from nation
join (select s_nationkey as k, sum(s_acctbal) as v from supplier group by 1) s on s.k = n_nationkey
left join (select c_nationkey as k, sum(c_acctbal) as v from customer group by 1) c on c.k = n_nationkey"""


def official(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("ours"))
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("c"))
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "k")
    return n.join(s, "k").join(c, "k", "left").select(F.col("n_name").alias("zone"), "ours", F.expr("if(k % 5 <> 4, c, null)").alias("theirs"))
