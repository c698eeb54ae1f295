"""Daily and hourly series: windows with lags, reservoirs, indices, interpolation, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverlens.functions.calendar import assign_window, in_season, season_day
from riverlens.operators.ordered import carried, quantiles
from riverlens.operators.ranking import dedupe  # noqa: F401  (W12 belongs to the reservoir readings)


def _range_join(daily: DataFrame, windows: DataFrame, day: str) -> DataFrame:
    """windows (window_start, lo, hi) left-joined with the days in [lo, hi): an equi-join on each
    window's days, so that no nested loop is needed. An empty range keeps its row."""
    days = F.when(F.col("lo") < F.col("hi"), F.sequence("lo", F.date_sub("hi", 1)))
    w = windows.withColumn("_day", F.explode_outer(days))
    return w.join(daily.withColumnRenamed(day, "_day"), "_day", "left")


def window_sum(daily: DataFrame, windows: DataFrame, value: str, day: str = "date") -> DataFrame:
    """A15. Sum per window, NULL when no day has a value, and the number of days that have one."""
    j = _range_join(daily.select(day, value), windows.select("window_start", F.col("window_start").alias("lo"), F.col("window_end").alias("hi")), day)
    return j.groupBy("window_start").agg(F.sum(value).alias(value), F.count(value).alias("days"))


def window_with_lags(daily: DataFrame, windows: DataFrame, value: str, lags: int = 2, day: str = "date") -> DataFrame:
    """A16. The sum of each window and of the stretches before it: lag k shifts by k times the
    window's own length."""
    n = F.datediff("window_end", "window_start")
    k = windows.select("window_start", "window_end", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("k"))
    shifted = k.select("window_start", "k", F.date_sub("window_start", F.col("k") * n).alias("lo"), F.date_sub("window_end", F.col("k") * n).alias("hi"))
    per = _range_join(daily.select(day, value), shifted, day).groupBy("window_start").pivot("k", list(range(lags + 1))).agg(F.sum(value))
    return per.select("window_start", *(F.col(str(i)).alias(f"{value}_lag{i}") for i in range(lags + 1)))


def reservoir_windows(daily: DataFrame, windows: DataFrame, dams: DataFrame) -> DataFrame:
    """A17. Mean storage and last less first reading, a row for every dam and window."""
    have = daily.where(F.col("storage").isNotNull()).select(F.col("date").alias("d"), "dam", "storage")
    w = windows.select("window_start", F.explode(F.sequence("window_start", F.date_sub("window_end", 1))).alias("d"))
    per = have.join(F.broadcast(w), "d").groupBy("window_start", "dam").agg(
        F.avg("storage").alias("mean_storage"), (F.max_by("storage", "d") - F.min_by("storage", "d")).alias("delta_storage")
    )
    full = dams.select("dam").distinct().crossJoin(F.broadcast(windows.select("window_start")))  # windows are a calendar
    return full.join(per, ["window_start", "dam"], "left")


def pivot_reservoirs(df: DataFrame, dams: list[str]) -> DataFrame:
    """A18. One row a window; the dams are named, so that the plan needs no first pass."""
    from riverlens.functions.scalars import slug

    wide = df.withColumn("dam", slug("dam")).groupBy("window_start").pivot("dam", dams)
    return wide.agg(F.avg("mean_storage").alias("mean"), F.avg("delta_storage").alias("delta"))


def area_mean(cells: DataFrame, keys=("hour",), value: str = "mm", lat: str = "lat") -> DataFrame:
    """A19. Weighted by cos(lat); missing cells carry no weight."""
    w = F.cos(F.radians(lat))
    return cells.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(F.when(F.col(value).isNotNull(), w))).alias(value))


def window_intensity(hourly: DataFrame, window_col: str = "window_start", value: str = "mm") -> DataFrame:
    """A20. Largest sum of 3 and of 24 hours and hours of 5 mm or more; missing hours count 0, a
    shorter series sums what it has."""
    part = Window.partitionBy(window_col).orderBy("hour")
    v = F.coalesce(F.col(value), F.lit(0.0))
    h = hourly.withColumn("n", F.count("*").over(Window.partitionBy(window_col))).withColumn("i", F.row_number().over(part))
    for k in (3, 24):
        full = F.col("i") >= F.least(F.lit(k), F.col("n"))
        h = h.withColumn(f"s{k}", F.when(full, F.sum(v).over(part.rowsBetween(-k + 1, 0))))
    return h.groupBy(window_col).agg(F.max("s3").alias("max3h"), F.max("s24").alias("max24h"), F.count_if(v >= 5).alias("hours5"))


def wet_threshold(daily: DataFrame, years: tuple[int, int], value: str, q: float = 0.95, wet: float = 1.0) -> DataFrame:
    """A21. Quantile of wet days (at or above `wet`) in the base years' season."""
    d = daily.where(F.year("date").between(*years) & in_season("date") & (F.col(value) >= wet))
    # one row also where no day is wet
    return quantiles(d, value, [q]).agg(F.max(F.col("quantiles")[0]).alias("threshold"))


def annual_indices(daily: DataFrame, value: str, threshold: DataFrame) -> DataFrame:
    """A22. Per year's season: days at or above the threshold, largest 5-day sum, total."""
    five = Window.partitionBy("year").orderBy("date").rowsBetween(-4, 0)
    d = daily.where(in_season("date")).withColumn("year", F.year("date"))
    d = d.withColumn("s5", F.when(F.count(value).over(five) == 5, F.sum(value).over(five)))
    g = d.crossJoin(F.broadcast(threshold)).groupBy("year")
    return g.agg(F.count_if(F.col(value) >= F.col("threshold")).alias("heavy_days"), F.max("s5").alias("rx5day"), F.sum(value).alias("total"))


def same_day_band(daily: DataFrame, targets: DataFrame, value: str, qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """A23. Quantiles of earlier years' values on each target's calendar day."""
    md = lambda c: F.date_format(c, "MM-dd")
    t = targets.select("date").distinct()
    first = t.agg(F.min(F.year("date")).alias("y0"))
    past = daily.crossJoin(F.broadcast(first)).where(F.year("date") < F.col("y0")).groupBy(md("date").alias("md"))
    band = past.agg(*(F.percentile(value, F.lit(q)).alias(f"q{round(100 * q)}") for q in qs), F.count(value).alias("n"))
    return t.withColumn("md", md("date")).join(band, "md", "left").drop("md")


def fill_curve(daily: DataFrame, years: tuple[int, int], value: str = "storage", days: int = 122) -> DataFrame:
    """A24. Per dam and day of season: quantiles over the years, distinct years, observations; days
    without any observation keep their row."""
    d = daily.where(F.year("date").between(*years) & in_season("date") & F.col(value).isNotNull()).withColumn("sday", season_day("date"))
    g = d.groupBy("dam", "sday").agg(
        *(F.percentile(value, F.lit(q)).alias(f"q{round(100 * q)}") for q in (0.25, 0.5, 0.75)), F.countDistinct(F.year("date")).alias("n_years"), F.count("*").alias("n_obs")
    )
    full = daily.select("dam").distinct().crossJoin(daily.sparkSession.range(days).select(F.col("id").cast("int").alias("sday")))
    return full.join(g, ["dam", "sday"], "left").withColumns({"n_years": F.coalesce("n_years", F.lit(0)), "n_obs": F.coalesce("n_obs", F.lit(0))})


def interpolate(points: DataFrame, targets: DataFrame, x: str, y: str, keys: tuple = (), clamp: bool = False) -> DataFrame:
    """W9. Piecewise-linear between points, NULL outside their span (W10: clamped at both ends).
    Points and targets are ordered together, range by range, so that one series may be of any length;
    no range join. x is numeric or a date."""
    num = (lambda c: F.unix_date(c).cast("double")) if dict(points.dtypes)[x] == "date" else (lambda c: F.col(c).cast("double"))
    p = points.where(F.col(y).isNotNull()).groupBy(*keys, x).agg(F.avg(y).alias(y))
    p = p.select(*keys, F.col(x), num(x).alias("_x"), F.struct(num(x).alias("x"), F.col(y).alias("y")).alias("p"), F.lit(False).alias("t"))
    t = targets.select(*keys, F.col(x), num(x).alias("_x"), F.lit(None).cast(p.schema["p"].dataType).alias("p"), F.lit(True).alias("t"))
    u = carried(p.unionByName(t), "_x", "p", "a", "b", keys).where("t")
    line = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * F.try_divide(F.col("_x") - F.col("a.x"), F.col("b.x") - F.col("a.x"))
    v = F.when(F.col("a.x") == F.col("b.x"), F.col("a.y")).otherwise(line)
    v = F.coalesce(v, F.col("a.y"), F.col("b.y")) if clamp else v
    return u.select(*keys, x, v.alias(y))


def rating(levels: DataFrame, pairs: DataFrame, keys: tuple = ("dam",)) -> DataFrame:
    """W10. Storage of a level by the dam's level-storage pairs."""
    return interpolate(pairs, levels, "level", "storage", keys, clamp=True)


def rolling(df: DataFrame, order: str, value: str, keys: tuple = (), back: int = 4, centred: int = 3, least: int = 2) -> DataFrame:
    """W11. Moving sum over back + 1 rows (full frames only) and centred mean with least periods."""
    w = Window.partitionBy(*keys).orderBy(order)
    past, mid = w.rowsBetween(-back, 0), w.rowsBetween(-centred, centred)
    c = F.col(value)
    return df.withColumns({
        "moving_sum": F.when(F.count(c).over(past) == back + 1, F.sum(c).over(past)),
        "centred_mean": F.when(F.count(c).over(mid) >= least, F.avg(c).over(mid)),
    })


def contiguous_start(years: DataFrame) -> DataFrame:
    """W13. First year of the last run without a gap (gaps and islands)."""
    y = years.select("year").distinct()
    isl = y.withColumn("island", F.col("year") - F.row_number().over(Window.orderBy("year")))
    return isl.groupBy("island").agg(F.min("year").alias("start"), F.max("year").alias("last")).agg(F.max_by("start", "last").alias("start"))


def lag1_autocorr(series: DataFrame, t: str, v: str, keys: tuple = ("series",)) -> DataFrame:
    """W14. r1 per series."""
    w = Window.partitionBy(*keys)
    d = series.withColumn("d", F.col(v) - F.avg(v).over(w)).withColumn("p", F.lag("d").over(w.orderBy(t)))
    return d.groupBy(*keys).agg(F.try_divide(F.sum(F.col("d") * F.col("p")), F.sum(F.col("d") * F.col("d"))).alias("r1"), F.count("*").alias("n"))


def prewhiten(series: DataFrame, t: str, v: str, keys: tuple = ("series",)) -> DataFrame:
    """W14. v(t) - r1 v(t-1), without the first value."""
    r = lag1_autocorr(series, t, v, keys).select(*keys, "r1")
    j = series.join(r, list(keys))
    w = Window.partitionBy(*keys).orderBy(t)
    j = j.withColumn("_p", F.lag(v).over(w))
    return j.where(F.col("_p").isNotNull()).select(*keys, t, (F.col(v) - F.col("r1") * F.col("_p")).alias(v))


def add_lags(df: DataFrame, col: str, k: int, key: str = "zone", order: str = "window_start") -> DataFrame:
    """W1. Row shifts per zone in time order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"{col}_lag{i}": F.lag(col, i).over(w) for i in range(1, k + 1)})


def assemble(df: DataFrame) -> DataFrame:
    """W2. Antecedent fraction, carried across seasons, and week of season from 0."""
    w = Window.partitionBy("zone").orderBy("window_start")
    y = Window.partitionBy("zone", "year").orderBy("window_start")
    return df.withColumns({"antecedent": F.lag("fraction").over(w), "week": F.row_number().over(y) - 1})


def risk_rank(df: DataFrame, score: str = "prob") -> DataFrame:
    """W3. rank() is the minimum method."""
    return df.withColumn("risk_rank", F.rank().over(Window.partitionBy("window_start").orderBy(F.desc(score))))


def peak_rank(df: DataFrame, score: str = "prob") -> DataFrame:
    """W4. Peak score per zone with its first window; rank over zones, name for ties."""
    g = df.groupBy("zone").agg(F.max(score).alias("peak"), F.max_by("window_start", F.struct(F.col(score), -F.unix_date("window_start"))).alias("peak_window"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("peak"), "zone")))


def basis_for(dates: DataFrame, cited: DataFrame, keys: tuple = ()) -> DataFrame:
    """J12. Nearest cited date at or before and at or after each date, the gap and how it was found."""
    day = F.unix_date("date").cast("double").alias("_x")
    c = cited.select(*keys, "date", day, F.col("date").alias("c"), F.lit(False).alias("t")).distinct()
    t = dates.select(*keys, "date", day, F.lit(None).cast("date").alias("c"), F.lit(True).alias("t"))
    u = carried(c.unionByName(t), "_x", "c", "before", "after", keys).where("t")
    tag = F.when(F.col("before") == F.col("after"), "cited").when(F.col("before").isNotNull() & F.col("after").isNotNull(), "interpolated").otherwise("none")
    return u.select(*keys, "date", "before", "after", F.datediff("after", "before").alias("gap"), tag.alias("basis"))


def headroom_table(daily: DataFrame, cited: DataFrame, year: int, base: tuple[int, int], capacity: float) -> DataFrame:
    """A28. A target year's season by dam: dense readings, else interpolated cited ones, with the
    median curve, the deficit against it and how each value was found."""
    days = daily.where(F.year("date") == year).where(in_season("date")).select("dam", "date").distinct()
    dense = daily.where(F.col("storage").isNotNull()).select("dam", "date", F.col("storage").alias("dense"))
    line = interpolate(cited.select("dam", "date", "storage"), days, "date", "storage", ("dam",))
    basis = basis_for(days, cited, ("dam",)).select("dam", "date", "basis")
    curve = fill_curve(daily, base).select("dam", "sday", F.col("q50").alias("median"))
    j = days.join(dense, ["dam", "date"], "left").join(line, ["dam", "date"], "left").join(basis, ["dam", "date"], "left")
    j = j.withColumn("sday", season_day("date")).join(curve, ["dam", "sday"], "left")
    value = F.coalesce("dense", "storage")
    return j.select(
        "dam", "date", value.alias("storage"), "median", (value - F.col("median")).alias("deficit_bcm"), (100 * (value - F.col("median")) / capacity).alias("deficit_pct"),
        F.when(F.col("dense").isNotNull(), "dense").otherwise(F.col("basis")).alias("basis"),
    )


def assigned(daily: DataFrame, day: str = "date") -> DataFrame:
    return assign_window(daily, day)
