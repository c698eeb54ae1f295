"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverlens import config as C


def state_totals(df: DataFrame, key: str, total: str, order: str) -> DataFrame:
    """T1. Totals in descending order; equal totals keep the order of `order`."""
    g = df.groupBy(key).agg(F.sum(total).alias("total"), F.min(order).alias("ord"))
    return g.orderBy(F.desc("total"), "ord")


def zone_rows(df: DataFrame, floor: float = C.ALERT_KM2) -> DataFrame:
    """T2. From (zone, flooded_ha): km2 in descending order, then name, with the alert flag (>=)."""
    km2 = F.col("flooded_ha") / 100
    return df.select("zone", km2.alias("km2"), (km2 >= floor).alias("flagged")).orderBy(F.desc("km2"), "zone")


def top_victims(df: DataFrame, n: int) -> DataFrame:
    """T3. Three keys, the name last for ties: TakeOrderedAndProject."""
    return df.orderBy(F.desc("seasons_2pct"), F.desc("max_fraction"), F.desc("mean_ha"), "zone").limit(n)


def top_per_group(df: DataFrame, k: int, group: str, *order) -> DataFrame:
    """T4. Spark limits each group in every task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def _nowcast_keys(active: bool) -> list:
    return [*([F.coalesce(-F.col("p"), F.lit(1.0))] if active else []), -F.coalesce("km2", F.lit(0.0)), F.col("zone")]


def nowcast_order(df: DataFrame, active: bool = True) -> DataFrame:
    """T5. By score, then area, then name, missing last; by area alone before activation."""
    return df.orderBy(*_nowcast_keys(active))


def nowcast_places(df: DataFrame, keys, active: bool = True) -> DataFrame:
    """T5. The place of each zone in that order among the rows of the same keys, from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*_nowcast_keys(active))))


def union_strata(*strata: tuple[str, DataFrame], key: str = "pixel") -> DataFrame:
    """U1. Strata one after the other, each without what an earlier one holds, with a tag."""
    out: DataFrame | None = None
    for tag, df in strata:
        new = df.select(key).distinct()
        new = (new if out is None else new.join(out, key, "left_anti")).withColumn("stratum", F.lit(tag))
        out = new if out is None else out.unionByName(new)
    return out


def minus(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """U2."""
    return df.join(used.select(key).distinct(), key, "left_anti")


def mask_sets(px: DataFrame, a: str, b: str, key: str = "id") -> DataFrame:
    """U3. Members of both, either, only one of two masks, from one scan."""
    x, y = F.col(a), F.col(b)
    kinds = F.array_compact(F.array(F.when(x & y, "both"), F.when(x | y, "either"), F.when(x != y, "one")))
    return px.select(key, F.explode(kinds).alias("set"))


def append_record(hist: DataFrame, recent: DataFrame, key: str) -> DataFrame:
    """U4. Historical and recent rows; for a date in both the recent one stands."""
    u = hist.withColumn("_p", F.lit(1)).unionByName(recent.withColumn("_p", F.lit(0)))
    return top_per_group(u, 1, key, "_p").drop("_p", "rn")


def dedupe(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """W12. One row a key, the first by preference."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def coalesce_sources(keys: list[str], value: str, *sources: DataFrame) -> DataFrame:
    """J9. The first source that has a value for a key, and its number."""
    tagged = [s.select(*keys, F.col(value), F.lit(i).alias("source")) for i, s in enumerate(sources)]
    u = reduce(DataFrame.unionByName, tagged)
    ok = F.col(value).isNotNull()
    return u.groupBy(*keys).agg(F.min_by(value, F.when(ok, F.col("source"))).alias(value), F.min(F.when(ok, F.col("source"))).alias("source"))
