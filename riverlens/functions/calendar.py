"""Season windows, day arithmetic and period labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverlens import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _md(year: Column, md: str) -> Column:
    m, d = md.split("-")
    return F.make_date(year, F.lit(int(m)), F.lit(int(d)))


def season_windows(spark: SparkSession, years, start_md: str = C.SEASON_START, end_md: str = C.SEASON_END, days: int = C.WINDOW_DAYS) -> DataFrame:
    """K1. year, idx, window_start, window_end: half-open windows, the last cut at the season's end.
    years: numbers, or a table with a column year."""
    y = years.select(F.col("year").cast("int").alias("year")) if isinstance(years, DataFrame) else spark.createDataFrame([(int(v),) for v in years], "year int")
    start, end = _md(F.col("year"), start_md), _md(F.col("year"), end_md)
    w = y.select("year", F.posexplode(F.sequence(start, F.date_sub(end, 1), F.expr(f"interval {days} days"))).alias("idx", "window_start"))
    return w.select("year", "idx", "window_start", F.least(F.date_add("window_start", days), end).alias("window_end"))


def run_manifest(spark: SparkSession, years) -> DataFrame:
    """K2. Windows with their dry-season baseline (March to May of the year) and an export key."""
    w = season_windows(spark, years)
    key = F.concat_ws("_", F.lit("wet"), F.date_format("window_start", "yyyyMMdd"), F.date_format("window_end", "yyyyMMdd"))
    return w.select("year", "window_start", "window_end", _md(F.col("year"), "03-01").alias("baseline_start"), _md(F.col("year"), "05-31").alias("baseline_end"), key.alias("export_key"))


def window_index(day, start_md: str = C.SEASON_START, end_md: str = C.SEASON_END, days: int = C.WINDOW_DAYS) -> Column:
    day = _col(day)
    start = _md(F.year(day), start_md)
    inside = (day >= start) & (day < _md(F.year(day), end_md))
    return F.when(inside, F.floor(F.datediff(day, start) / days).cast("int"))


def assign_window(df: DataFrame, day_col: str, start_md: str = C.SEASON_START, end_md: str = C.SEASON_END, days: int = C.WINDOW_DAYS) -> DataFrame:
    """K3. df with window_start, NULL outside every window: arithmetic, no join."""
    start = _md(F.year(_col(day_col)), start_md)
    return df.withColumn("window_start", F.date_add(start, window_index(day_col, start_md, end_md, days) * days))


def assign_interval(df: DataFrame, day_col: str, intervals: DataFrame) -> DataFrame:
    """K3 for any half-open intervals (start, end, label): a join on months, then the exact test."""
    i = intervals.withColumn("_m", F.explode(F.sequence(F.trunc("start", "month"), F.trunc(F.date_sub("end", 1), "month"), F.expr("interval 1 month"))))
    d = df.withColumn("_d", F.trunc(day_col, "month"))
    return d.join(i, (F.col("_d") == F.col("_m")) & (F.col(day_col) >= F.col("start")) & (F.col(day_col) < F.col("end")), "left").drop("_d", "_m")


def filter_days(df: DataFrame, start: str, end: str, day_col: str = "day") -> DataFrame:
    """K4. Closed interval."""
    return df.where(F.col(day_col).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def day_offset(c, origin: str) -> Column:
    """K5."""
    return F.datediff(_col(c), F.to_date(F.lit(origin)))


def season_day(c, md: str = C.CLIMATE_START) -> Column:
    """K6. Days since the season start of the date's own year, so leap days do not shift it."""
    return F.datediff(_col(c), _md(F.year(_col(c)), md))


def in_season(c, start_md: str = C.CLIMATE_START, end_md: str = C.CLIMATE_END) -> Column:
    """K7."""
    return F.date_format(_col(c), "MM-dd").between(start_md, end_md)


def core_season(c, cutoff_md: str = C.CORE_FROM) -> Column:
    """K8."""
    return F.date_format(_col(c), "MM-dd") >= cutoff_md


def calendar(spark: SparkSession, start: str, end: str, upto: str | None = None) -> DataFrame:
    """K9. Days of [start, end), or only those up to a day."""
    last = F.date_sub(F.to_date(F.lit(end)), 1)
    last = F.least(last, F.to_date(F.lit(upto))) if upto else last
    first = F.to_date(F.lit(start))
    return spark.range(1).select(F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))).alias("day"))


def resolve_window(dates: DataFrame, day_col: str = "day") -> DataFrame:
    """K10. The window of each date with index, phase, core flag, activation date and the two windows
    before; before the season the first window stands, after it the last."""
    d, y = F.col(day_col), F.year(F.col(day_col))
    start, end = _md(y, C.SEASON_START), _md(y, C.SEASON_END)
    last = F.floor((F.datediff(end, start) - 1) / C.WINDOW_DAYS).cast("int")
    idx = F.when(d < start, F.lit(0)).when(d >= end, last).otherwise(window_index(d))
    at = lambda k: F.when(idx >= k, F.date_add(start, (idx - k) * C.WINDOW_DAYS))
    phase = F.when(d < start, "before").when(d >= end, "after").otherwise("in")
    return dates.select(
        d.alias(day_col), phase.alias("phase"), idx.alias("idx"), at(0).alias("window_start"), F.least(F.date_add(at(0), C.WINDOW_DAYS), end).alias("window_end"),
        at(1).alias("previous_1"), at(2).alias("previous_2"), core_season(at(0)).alias("core"), _md(y, C.CORE_FROM).alias("active_from"),
    )


def local_day(ts, tz: str = "+05:30") -> Column:
    """K11."""
    return F.to_date(F.from_utc_timestamp(_col(ts), tz))


def scene_date(c) -> Column:
    """K12. The date in a scene name: 05SEP2025 or 05092025, else ISO 2025-09-05, else NULL."""
    c = F.upper(_col(c))
    word = F.try_to_timestamp(F.initcap(F.regexp_extract(c, r"(\d{2}[A-Z]{3}\d{4})", 1)), F.lit("ddMMMyyyy"))
    number = F.try_to_timestamp(F.regexp_extract(c, r"(?<!\d)(\d{8})(?!\d)", 1), F.lit("ddMMyyyy"))
    iso = F.try_to_timestamp(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    return F.to_date(F.coalesce(word, number, iso))


def classify_scene(day, wet: tuple[str, str], pre: tuple[str, str]) -> Column:
    """K12. wet, pre, other or undated, closed date ranges."""
    day = _col(day)
    return F.when(day.isNull(), "undated").when(day.between(*map(F.lit, wet)), "wet").when(day.between(*map(F.lit, pre)), "pre").otherwise("other")


def period_year(c) -> Column:
    """K13. 2016 -> 2016, 2018-19 -> 2018, 1953-2010 -> NULL; anything else is an error."""
    c = F.trim(_col(c))
    year = F.substring(c, 1, 4).cast("int")
    return F.when(c.rlike(r"^\d{4}$|^\d{4}-\d{2}$"), year).when(c.rlike(r"^\d{4}-\d{4}$"), F.lit(None).cast("int")).when(c.isNull(), F.lit(None).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a period: "), c)).cast("int"))


def complete_years(daily: DataFrame, day_col: str = "date", least: int = 120) -> DataFrame:
    """K14. year, days of years with enough season days."""
    d = daily.where(in_season(day_col)).groupBy(F.year(day_col).alias("year")).agg(F.countDistinct(day_col).alias("days"))
    return d.where(F.col("days") >= least)


def base_years(years: DataFrame, first: int, last: int, least: int = 25, fallback: int = 30) -> DataFrame:
    """K14. The years of the base period, or the first `fallback` years when it has fewer than `least`."""
    w = Window.orderBy("year")
    tagged = years.select("year").withColumn("rn", F.row_number().over(w))
    inside = F.col("year").between(first, last)
    n = tagged.agg(F.count_if(inside).alias("n"))
    return tagged.crossJoin(F.broadcast(n)).where(((F.col("n") >= least) & inside) | ((F.col("n") < least) & (F.col("rn") <= fallback))).select("year")
