"""Panels of zones and windows put together from tables of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_panel(target: DataFrame, *features: DataFrame, on=("window_start",)) -> DataFrame:
    """J1. Target left-joined to feature tables on the window; Spark broadcasts the small sides."""
    for f in features:
        target = target.join(f, list(on), "left")
    return target


def add_prior(df: DataFrame, prior: DataFrame, cols, prefix: str = "prior_", key: str = "zone") -> DataFrame:
    """J2. Prefixed columns of one row a zone; the prior is made unique, so rows never multiply."""
    p = prior.dropDuplicates([key]).select(key, *(F.col(c).alias(prefix + c) for c in cols))
    return df.join(p, key, "left")


def flooded_fraction(df: DataFrame, areas: DataFrame, key: str = "zone") -> DataFrame:
    """J3. A zone without an area is an error."""
    j = df.join(areas.select(key, "area_ha"), key, "left")
    area = F.when(F.col("area_ha").isNull(), F.raise_error(F.concat(F.lit("no area: "), F.col(key))).cast("double")).otherwise(F.col("area_ha"))
    return j.withColumn("fraction", F.coalesce(F.try_divide(F.col("flooded_ha"), area), F.lit(0.0)))
