"""Queries of the sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from riverlens.functions import scalars as P
from riverlens.session import scratch
from riverlens.sources import tables as S

from .base import dam_daily, hourly, inline, panel, px_pass, query, r4, scenes, table


@query("s1_read_table", "select n_nationkey, n_name, n_regionkey from nation")
def s1(spark, sf):
    path = scratch(spark, "s1")
    table(spark, sf, "nation").write.option("header", True).csv(path)
    return S.read_table(spark, path, "n_nationkey int, n_name string, n_regionkey int", ["n_nationkey", "n_name"])


@query("s2_tidy_zone_export", "select zone, year, window_start, round(flooded_ha, 4) as flooded_ha, round(area_ha, 4) as area_ha from panel")
def s2(spark, sf):
    p = panel(spark, sf).select(F.col("area_ha").cast("string").alias("area_ha"), F.col("zone").alias("ADM2_NAME"), F.col("flooded_ha").cast("string").alias("flooded_ha"), "window_start", F.col("year").cast("string").alias("year"))
    t = S.tidy_zone_export(p)
    return t.select("zone", "year", "window_start", r4("flooded_ha", "flooded_ha"), r4("area_ha", "area_ha"))


@query("s3_read_pass_masks", "select pixel, day, wet from px_pass where day between date '2024-01-10' and date '2024-01-20'")
def s3(spark, sf):
    path = scratch(spark, "s3")
    px_pass(spark, sf).withColumn("season", F.year("day")).write.partitionBy("season", "day").parquet(path)
    return S.read_pass_masks(spark, path, "2024-01-10", "2024-01-20").select("pixel", "day", "wet")


def geojson(spark) -> str:
    """Four zones over the pixel grid (one of two parts, one with a hole), written as GeoJSON."""
    ring = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    shapes = [
        ("north", "Polygon", [ring(0, 0, 16, 3)]),
        ("east", "Polygon", [ring(16, 0, 32, 3), ring(20, 1, 22, 2)]),
        ("far", "MultiPolygon", [[ring(0, 3, 8, 60)], [ring(24, 3, 32, 60)]]),
        ("middle", "Polygon", [ring(8, 3, 24, 60)]),
    ]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"district": n}, "geometry": {"type": t, "coordinates": c}} for n, t, c in shapes]}
    path = scratch(spark, "s4")
    inline(spark, [(json.dumps(doc),)], "value string").coalesce(1).write.text(path)
    return path


def nation_geojson(spark, sf) -> str:
    """The boxes of nation_boxes, written as one GeoJSON document."""
    n = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").cast("double").alias("k"))
    k, d = F.col("k"), lambda v: F.lit(float(v))
    ring = lambda x0, y0, x1, y1: F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    shell, second, hole = ring(k * 8, d(3), k * 8 + 4 + k % 3, k + 20), ring(k * 8, d(100), k * 8 + 2, d(110)), ring(k * 8 + 1, d(4), k * 8 + 2, d(6))
    first = F.when(k % 4 == 1, F.array(shell, hole)).otherwise(F.array(shell))
    shape = F.when(k % 5 == 0, F.struct(F.lit("MultiPolygon").alias("type"), F.to_json(F.array(first, F.array(second))).alias("coordinates")))
    shape = shape.otherwise(F.struct(F.lit("Polygon").alias("type"), F.to_json(first).alias("coordinates")))
    one = n.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("district"), "n_name").alias("properties"), shape.alias("geometry"))).alias("f"))
    doc = one.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.sort_array(F.collect_list("f")), ", "), F.lit("]}")).alias("value"))
    path = scratch(spark, "boundaries")
    doc.select(F.regexp_replace("value", r'"coordinates":"(\[[^"]*\])"', r'"coordinates":$1').alias("value")).coalesce(1).write.text(path)
    return path


@query(
    "s4_read_polygons",
    """select dense_rank() over (order by zone) as label, zone, part, ring, i, case when i in (0, 3) then x0 else x1 end as x1, case when i < 2 then y0 else y1 end as y1,
      case when i in (0, 1) then b.x1 else x0 end as x2, case when i in (1, 2) then b.y1 else y0 end as y2 from nation_boxes b cross join range(4) r(i)""",
)
def s4(spark, sf):
    e = S.read_polygons(spark, nation_geojson(spark, sf))
    return e.select(F.col("label").cast("long").alias("label"), "zone", "part", "ring", F.col("i").cast("long").alias("i"), "x1", "y1", "x2", "y2")


@query("s5_filter_features", "select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 3")
def s5(spark, sf):
    return S.filter_features(table(spark, sf, "nation"), "n_regionkey", 3, "n_name")


@query("s6_union_sources", "select date, dam, round(storage, 4) as storage, null::varchar as source from dam_daily union all select * from (values (date '2001-01-01', 'X', 1.5, 'note'), (date '2001-01-02', 'X', null, 'note')) v")
def s6(spark, sf):
    more = inline(spark, [("2001-01-01", "X", 1.5, "note"), ("2001-01-02", "X", None, "note")], "date string, dam string, storage double, source string").withColumn("date", F.to_date("date"))
    return S.union_sources(dam_daily(spark, sf).select("date", "dam", r4("storage", "storage")), more)


@query("s7_read_rain_cells", "select hour, point, round(case when mm - 0.5 >= 0 then mm - 0.5 end, 4) as mm from hourly")
def s7(spark, sf):
    return S.mask_fill(hourly(spark, sf).withColumn("mm", F.col("mm") - 0.5)).select("hour", "point", r4("mm", "mm"))


@query("s8_write_product", "select zone, window_start, round(fraction, 3) as fraction from panel")
def s8(spark, sf):
    return S.write_product(panel(spark, sf), scratch(spark, "s8"), {"fraction": 3}, ["zone", "window_start"], ["zone", "window_start", "fraction"])


@query(
    "s9_publish_snapshot",
    """select window_start::varchar as "window", (row_number() over (partition by window_start order by flooded_ha desc, zone) - 1)::int as place, zone, round(flooded_ha / 2, 4) as km2, flooded_ha / 2 >= 25 as flagged, null::double as nowcast from panel""",
)
def s9(spark, sf):
    """The snapshots of all windows, read back from their JSON texts."""
    p = panel(spark, sf).withColumn("window", F.col("window_start").cast("string"))
    header = p.select("window").distinct().withColumn("nowcast", F.lit(None).cast("double"))
    texts = S.publish_snapshot(header, p.select("window", "zone", (F.col("flooded_ha") / 2).alias("km2")), keys=("window",))
    zone = "array<struct<zone: string, km2: double>>"
    v = texts.select(F.from_json("value", f"window string, nowcast double, zones {zone}, flagged {zone}").alias("v")).select("v.window", "v.nowcast", "v.flagged", F.posexplode("v.zones").alias("place", "z"))
    return v.select("window", "place", "z.zone", r4("z.km2", "km2"), F.exists("flagged", lambda x: x["zone"] == F.col("z.zone")).alias("flagged"), "nowcast")


@query("s10_pending_days", "select distinct day from px_pass where day >= date '2024-01-15'")
def s10(spark, sf):
    """Days that two appended runs of a ledger lack."""
    days, path = px_pass(spark, sf).select("day").distinct(), scratch(spark, "ledger")
    for part in ("day < date '2024-01-08'", "day between date '2024-01-06' and date '2024-01-14'"):
        S.append_ledger(days.where(part), path)
    return S.pending_days(days, spark.read.parquet(path))


@query("s11_quantize_db", "select pixel, orbit, ts, (case when power is null then -32768 else round(1000 * log10(greatest(power, 1e-6))) end)::int as q, case when power is not null then round(1000 * log10(greatest(power, 1e-6))) / 100 end as db from scenes")
def s11(spark, sf):
    s = scenes(spark, sf).withColumn("q", S.quantize_db(P.to_db("power")))
    return s.select("pixel", "orbit", "ts", F.col("q").cast("int").alias("q"), S.dequantize_db("q").alias("db"))


@query(
    "s12_pixel_grid",
    """with n as (select max(user_id) // 32 + 1 as rows from events)
    select 'grid' as kind, r as i, c as j, c + 0.5::double as x, rows - (r + 0.5::double) as y from n cross join range((select rows from n)) a(r) cross join range(32) b(c)
    union all select 'lattice', r, c, c * 16.0::double, r * rows / 2.0::double from n cross join range(3) a(r) cross join range(3) b(c)""",
)
def s12(spark, sf):
    """The grid and a lattice over the box of all pixels."""
    rows = table(spark, sf, "events").agg(F.expr("max(user_id) div 32 + 1").alias("n")).first().n
    box = (0.0, 0.0, 32.0, float(rows))
    g = S.pixel_grid(spark, box, 1.0).select(F.lit("grid").alias("kind"), F.col("row").alias("i"), F.col("col").alias("j"), "x", "y")
    return g.union(S.lattice(spark, box, 3).select(F.lit("lattice"), "i", "j", "x", "y"))
