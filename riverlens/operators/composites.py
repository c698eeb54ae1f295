"""Per-pixel composites over scenes and unions over days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def median_composite(scenes: DataFrame, keys=("pixel",), value: str = "power") -> DataFrame:
    """A1. Median ignoring nodata; all-nodata stays NULL."""
    return scenes.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias(value))


def min_composite(scenes: DataFrame, keys=("pixel",), value: str = "power") -> DataFrame:
    """A2. The wettest look."""
    return scenes.groupBy(*keys).agg(F.min(value).alias(value))


def phases(scenes: DataFrame, keys=("pixel",)) -> DataFrame:
    """Median dB before and in the wet phase, one shuffle for both."""
    from riverlens.functions.scalars import to_db

    at = lambda p: F.percentile(F.when(F.col("phase") == p, F.col("power")), F.lit(0.5))
    c = scenes.groupBy(*keys).agg(at("pre").alias("pre"), at("wet").alias("post"))
    return c.select(*keys, to_db("pre").alias("pre"), to_db("post").alias("post"))


def union_masks(px: DataFrame, keys=("pixel",)) -> DataFrame:
    """A3."""
    return px.groupBy(*keys).agg(F.bool_or("wet").alias("wet"))


def frequency_count(season_px: DataFrame, keys=("pixel",)) -> DataFrame:
    """A4. Seasons in which a pixel was wet."""
    return season_px.groupBy(*keys).agg(F.count_if("wet").alias("seasons_wet"))
