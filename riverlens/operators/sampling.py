"""Seeded samples: ordered by a hash of seed and id, so the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(seed: str, key: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")))


def balanced_sample(px: DataFrame, n: int, seed: str = "s", key: str = "pixel") -> DataFrame:
    """M1. n rows a class, spread evenly over its zones, topped up from what is left; all rows of a
    scarce class. px(key, label, zone, ...)."""
    zones = px.groupBy("label").agg(F.countDistinct("zone").alias("_z"))
    o = order_of(seed, key)
    d = px.join(F.broadcast(zones), "label").withColumn("_o", o)
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("label", "zone").orderBy("_o"))).where(F.col("_k") <= n)  # a top-k: no later row of a zone can be among n
    d = d.withColumn("_first", F.col("_k") <= F.ceil(F.lit(n) / F.col("_z"))).drop("_k")
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy("label").orderBy(~F.col("_first"), "_o")))
    return d.where(F.col("_rn") <= n).drop("_z", "_o", "_first", "_rn")


def draw(px: DataFrame, n: int, exclude: DataFrame | None = None, seed: str = "s", key: str = "pixel") -> DataFrame:
    """M2. Up to n rows without the excluded ones: a top-k, no full sort."""
    d = px.join(exclude.select(key).distinct(), key, "left_anti") if exclude is not None else px
    return d.orderBy(order_of(seed, key), key).limit(n)


def sample_features(px: DataFrame, ids: DataFrame, key: str = "pixel") -> DataFrame:
    """M3."""
    return ids.select(key).distinct().join(px, key)
