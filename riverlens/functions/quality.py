"""Data-quality rules: each gives the violations, so that an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverlens import config as C
from riverlens.functions.scalars import METRIC_CLASS


def check_totals(df: DataFrame, parts: list[str], total: str, label: str, total_label: str = "Total") -> DataFrame:
    """Q1. Rows whose parts do not add up, and the declared total row if the sums differ from it."""
    added = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    rows = df.where(F.col(label) != total_label)
    bad = rows.where(added != F.col(total)).select(F.col(label).alias("key"), F.lit("row").alias("rule"), added.cast("double").alias("found"), F.col(total).cast("double").alias("declared"))
    declared = df.where(F.col(label) == total_label).select(F.col(total).cast("double").alias("declared"))
    sums = rows.agg(F.sum(total).cast("double").alias("found"))
    whole = sums.crossJoin(F.broadcast(declared)).where("found <> declared").select(F.lit(total_label).alias("key"), F.lit("total").alias("rule"), "found", "declared")
    return bad.union(whole)


def check_history(df: DataFrame) -> DataFrame:
    """Q2. metric, unit, value (text) against what is known: one row for each rule broken."""
    number = F.col("value").try_cast("double")
    rules = {
        "unknown metric": ~F.col("metric").isin(*METRIC_CLASS),
        "unknown unit": ~F.lower("unit").isin(*C.HA_PER, "crore_inr", "count"),
        "not a number": number.isNull(),
        "negative": F.coalesce(number < 0, F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), name) for name, c in rules.items())))
    return df.select("metric", "unit", "value", F.explode(broken).alias("rule"))


def check_keys(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Q3. Keys without a row in the dimension."""
    return df.select(key).distinct().join(dim.select(key).distinct(), key, "left_anti")


def check_conservation(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """Q4. Totals of both and their ratio."""
    a, b = before.agg(F.sum(value).alias("before")), after.agg(F.sum(value).alias("after"))
    return a.crossJoin(F.broadcast(b)).withColumn("ratio", F.try_divide("after", "before"))


def gate(metrics: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """Q5. metric, value, target, ok."""
    j = targets.join(metrics, "metric", "left")
    return j.select("metric", "value", "target", F.coalesce(F.abs(F.col("value") - F.col("target")) <= tolerance, F.lit(False)).alias("ok"))


def check_bracket(days: DataFrame, spans: DataFrame) -> DataFrame:
    """Q6. Pixels whose observed days lie outside of 0 .. span."""
    return days.join(spans, "pixel").where("not (days >= 0 and days <= span)").select("pixel", "days", "span")
