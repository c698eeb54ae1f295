"""Zone statistics over pixel tables: extent, recurrence, duration, damage, people, methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverlens import config as C
from riverlens.functions.calendar import assign_window
from riverlens.functions.scalars import edge_class, merged_zone
from riverlens.operators.composites import union_masks


def subtract_mask(px: DataFrame, ref: DataFrame) -> DataFrame:
    """J16. Pixels without those of a reference mask (sparse)."""
    return px.join(ref.select("pixel").distinct(), "pixel", "left_anti")


def zone_fractions(px: DataFrame, pixel_ha: float = 1.0, keys=("zone",)) -> DataFrame:
    """A5. flooded_ha, area_ha, fraction with one pixel area; 0.0 for a zone without area."""
    wet = F.count_if(F.coalesce("wet", F.lit(False)))
    g = px.groupBy(*keys).agg((wet * pixel_ha).alias("flooded_ha"), (F.count("*") * pixel_ha).alias("area_ha"))
    return g.withColumn("fraction", F.coalesce(F.try_divide("flooded_ha", "area_ha"), F.lit(0.0)))


def zone_area(px: DataFrame, keys=("zone",)) -> DataFrame:
    """A6. As A5 with each pixel's own area m2; permanent water (perm) counts on neither side."""
    p = px.where(~F.coalesce("perm", F.lit(False)))
    wet = F.sum(F.when(F.coalesce("wet", F.lit(False)), F.col("m2")).otherwise(0.0)) / 1e4
    g = p.groupBy(*keys).agg(wet.alias("flooded_ha"), (F.sum("m2") / 1e4).alias("area_ha"))
    return g.withColumn("fraction", F.coalesce(F.try_divide("flooded_ha", "area_ha"), F.lit(0.0)))


def window_fractions(px: DataFrame, static: DataFrame, windows: DataFrame) -> DataFrame:
    """A7. Every zone and window: union of the window's days per pixel, then area. windows holds
    window_start of each day (day, window_start): a broadcast-sized calendar."""
    wet = px.where("wet").join(windows, "day").groupBy("pixel", "window_start").agg(F.lit(True).alias("wet"))
    land = static.where("not perm")
    area = land.groupBy("zone").agg((F.sum("m2") / 1e4).alias("area_ha"))
    flooded = wet.join(land, "pixel").groupBy("zone", "window_start").agg((F.sum("m2") / 1e4).alias("f"))
    full = area.crossJoin(F.broadcast(windows.select("window_start").distinct())).join(flooded, ["zone", "window_start"], "left")
    f = F.coalesce("f", F.lit(0.0))
    return full.select("zone", "window_start", f.alias("flooded_ha"), "area_ha", (f / F.col("area_ha")).alias("fraction"))


def repeat_victims(season: DataFrame) -> DataFrame:
    """A9. From (zone, season, fraction, flooded_ha) of all seasons; both thresholds strict."""
    return season.groupBy("zone").agg(
        F.count_if(F.col("fraction") > 0.01).alias("seasons_1pct"), F.count_if(F.col("fraction") > 0.02).alias("seasons_2pct"),
        F.max("fraction").alias("max_fraction"), F.avg("flooded_ha").alias("mean_ha"),
    )


def late_season(px: DataFrame, static: DataFrame, cutoff: str, season_of) -> DataFrame:
    """A8. A3, A6 and A9 over days from the cutoff on; season_of gives a day's season."""
    late = px.where(F.col("day") >= F.to_date(F.lit(cutoff))).withColumn("season", season_of)
    u = union_masks(late, ("pixel", "season"))
    return repeat_victims(zone_area(u.join(static.select("pixel", "zone", "perm", "m2"), "pixel"), ("zone", "season")))


def duration_zonal(px: DataFrame, crop_only: bool = False, keys=("zone",)) -> DataFrame:
    """A10. From per-pixel days: hectares per duration class, flooded hectares, mean and longest."""
    p = px.where("crop") if crop_only else px
    p = p.withColumn("class", edge_class("days", C.DURATION_EDGES))
    ha = F.col("m2") / 1e4
    per = [F.sum(F.when(F.col("class") == k, ha).otherwise(0.0)).alias(f"ha_{k}") for k in range(1, 5)]
    wet = F.col("class") > 0
    return p.groupBy(*keys).agg(*per, F.sum(F.when(wet, ha).otherwise(0.0)).alias("flooded_ha"), F.avg(F.when(wet, F.col("days"))).alias("mean_days"), F.max(F.when(wet, F.col("days"))).alias("max_days"))


def duration_damage(zonal: DataFrame, losses=C.DURATION_LOSS, keys=("zone",)) -> DataFrame:
    """A11. Loss-weighted value, the naive value of all flooded crops, and their ratio."""
    price = C.PADDY_T_PER_HA * C.PADDY_INR_PER_T
    weighted = sum((F.col(f"ha_{k}") * x for k, x in enumerate(losses, 1)), F.lit(0.0))
    d = zonal.select(*keys, (weighted * price).alias("damage_inr"), (F.col("flooded_ha") * price).alias("naive_inr"))
    return d.withColumn("damage_fraction", F.try_divide("damage_inr", "naive_inr"))


def population_exposed(px: DataFrame, keys=("zone",)) -> DataFrame:
    """A12. People in the mask, in the zone, and the share; non-finite counts are zero."""
    pop = F.when(F.isnan("pop") | F.col("pop").isNull(), 0.0).otherwise(F.col("pop"))
    g = px.groupBy(*keys).agg(F.sum(F.when(F.coalesce("wet", F.lit(False)), pop).otherwise(0.0)).alias("exposed"), F.sum(pop).alias("people"))
    return g.withColumn("share", F.coalesce(F.try_divide("exposed", "people"), F.lit(0.0)))


def method_table(px: DataFrame, methods=("a", "b"), crop: str = "c", pixel_ha: float = 1.0) -> DataFrame:
    """A13. Hectares by each method and of crops under the first, in one pass."""
    per = [(F.count_if(m) * pixel_ha).alias(f"{m}_ha") for m in methods]
    g = px.groupBy("zone").agg(*per, (F.count_if(F.col(methods[0]) & F.col(crop)) * pixel_ha).alias("crop_ha"), (F.count("*") * pixel_ha).alias("area_ha"))
    return g.withColumn("fraction", F.try_divide(f"{methods[0]}_ha", "area_ha"))


def value_v2(yields: DataFrame, wet: DataFrame, price: float = C.PADDY_INR_PER_T) -> DataFrame:
    """A14. yields(zone, production_t, area_ha): milled rice; split zones merged, area-weighted yield
    as paddy (milled is two thirds); value against the flat-yield value."""
    y = yields.groupBy(merged_zone("zone").alias("zone")).agg((F.sum("production_t") / F.sum("area_ha") / (2 / 3)).alias("yield_t_ha"))
    f = wet.groupBy(merged_zone("zone").alias("zone")).agg(F.sum("crop_ha").alias("crop_ha"))
    j = f.join(y, "zone", "left")
    v2 = F.col("crop_ha") * F.col("yield_t_ha") * price
    v1 = F.col("crop_ha") * C.PADDY_T_PER_HA * price
    return j.select("zone", "crop_ha", "yield_t_ha", v2.alias("value_v2"), v1.alias("value_v1"), (v2 - v1).alias("delta"))


def coverage(valid_px: DataFrame, zone_px: DataFrame) -> DataFrame:
    """A27. Share of each zone's pixels that a pass imaged."""
    v = valid_px.select("pixel").distinct().withColumn("ok", F.lit(True))
    return zone_px.select("pixel", "zone").join(v, "pixel", "left").groupBy("zone").agg((F.count("ok") / F.count("*")).alias("coverage"))


def polygon_area(edges: DataFrame) -> DataFrame:
    """A31. Shoelace area per zone; holes count negative (ring 0 is the shell)."""
    ring = edges.groupBy("zone", "part", "ring").agg(F.abs(F.sum(F.expr("x1 * y2 - x2 * y1")) / 2).alias("a"))
    return ring.groupBy("zone").agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))


def days_observed_wet(px: DataFrame, bridge: int = C.BRIDGE_DAYS) -> DataFrame:
    """W5. Wet passes plus the days between two consecutive wet passes at most `bridge` days apart."""
    w = Window.partitionBy("pixel").orderBy("day")
    p = px.withColumn("gap", F.datediff("day", F.lag("day").over(w))).withColumn("before", F.lag("wet").over(w))
    filled = F.when(F.col("wet") & F.col("before") & (F.col("gap") <= bridge), F.col("gap") - 1).otherwise(0)
    return p.groupBy("pixel").agg(F.sum(F.col("wet").cast("int") + filled).alias("days"))


def span_duration(px: DataFrame) -> DataFrame:
    """W6. Last wet day less the first, plus one; 0 for never wet."""
    wet = F.when(F.col("wet"), F.col("day"))
    return px.groupBy("pixel").agg(F.coalesce(F.datediff(F.max(wet), F.min(wet)) + 1, F.lit(0)).alias("span"))


def cumulative_and_fresh(px: DataFrame) -> DataFrame:
    """W7. New pixels per day, and all so far; one shuffle by pixel, then a window over days."""
    first = px.where("wet").groupBy("pixel").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("fresh"))
    days = px.select("day").distinct().join(first, "day", "left").select("day", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    return days.withColumn("total", F.sum("fresh").over(Window.orderBy("day")))


def pass_change(px: DataFrame) -> DataFrame:
    """W8. Each pass against the one before: wet pixels, newly wet ones, signed change."""
    day = Window.orderBy("day")
    n = px.select("day").distinct().withColumn("k", F.row_number().over(day))
    w = px.where("wet").join(F.broadcast(n), "day").select("pixel", "day", "k")
    old = w.select("pixel", (F.col("k") + 1).alias("k"), F.lit(1).alias("was"))
    per = w.join(old, ["pixel", "k"], "left").groupBy("day").agg(F.count("*").alias("wet_px"), F.count_if(F.col("was").isNull()).alias("new_px"))
    full = n.join(per, "day", "left").select("day", F.coalesce("wet_px", F.lit(0)).alias("wet_px"), F.coalesce("new_px", F.lit(0)).alias("new_px"))
    return full.withColumn("delta", F.col("wet_px") - F.lag("wet_px").over(day))


def peak_day(areas: DataFrame, area: str = "wet_px") -> DataFrame:
    """W8. The day of the largest area, the first of equals."""
    return areas.agg(F.max_by("day", F.struct(F.col(area), -F.unix_date("day"))).alias("peak_day"), F.max(area).alias("peak"))


def day_windows(px: DataFrame, day_col: str = "day") -> DataFrame:
    """The calendar that A7 joins: each distinct day with its season window."""
    return assign_window(px.select(F.col(day_col).alias("day")).distinct(), "day").where("window_start is not null")


def network_totals(stations: DataFrame, state: str = "state", kind: str = "kind", live: str = "live") -> DataFrame:
    """A26. Stations of a network and how many of them report, by state and kind, by either and in
    all: one pass for all four groupings. A state or kind that is missing counts as unknown."""
    named = stations.select(F.coalesce(state, F.lit("unknown")).alias(state), F.coalesce(kind, F.lit("unknown")).alias(kind), F.col(live).alias(live))
    g = named.cube(state, kind).agg(F.count("*").alias("stations"), F.count_if(live).alias("live"))
    return g.select(F.coalesce(state, F.lit("Total")).alias(state), F.coalesce(kind, F.lit("Total")).alias(kind), "stations", "live")
