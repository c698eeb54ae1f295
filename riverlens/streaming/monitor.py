"""The live monitor: arrivals by day, backlog, passes, alerts, running unions, as streaming plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlens import config as C
from riverlens.session import saved, scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_scenes(spark: SparkSession, path: str, glob: str = "events.parquet", schema: str = EVENTS) -> DataFrame:
    """Arriving files as a stream; times become timestamps of the session's zone."""
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, out: str | None = None, mode: str = "append") -> None:
    """All that has arrived, in one run; what a checkpoint has seen is not read again."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", out).start()
    q.awaitTermination()


def new_scenes(stream: DataFrame, key: str = "event_id", delay: str = "12 days") -> DataFrame:
    """R1. Each scene once, within the look-back."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def passes_by_day(stream: DataFrame) -> DataFrame:
    """R2. Arrivals per acquisition day."""
    w = stream.withWatermark("ts", "12 days") if stream.isStreaming else stream
    return w.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def plan_passes(batch: DataFrame, most: int = C.MAX_BACKLOG) -> DataFrame:
    """R3. Days of a batch of new scenes; beyond `most` scenes only the last day is taken up, the
    others are listed as skipped."""
    d = batch.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    whole = d.agg(F.sum("n").alias("all"), F.max("day").alias("last"))
    return d.crossJoin(F.broadcast(whole)).select("day", "n", ((F.col("all") > most) & (F.col("day") < F.col("last"))).alias("skipped"))


def run_monitor(batch: DataFrame, static: DataFrame, templates: DataFrame, floor: float = C.ALERT_KM2) -> DataFrame:
    """R4. One batch of passes: union, sieve, zonal area, flags, coverage and alerts as a snapshot.
    batch(pixel, day, wet); static(pixel, row, col, zone, perm, m2)."""
    from riverlens.functions.scalars import render_alerts
    from riverlens.operators.composites import union_masks
    from riverlens.operators.ranking import zone_rows
    from riverlens.operators.spatial import sieve
    from riverlens.operators.zonal import coverage, zone_area
    from riverlens.sources.tables import publish_snapshot

    seen = saved(union_masks(batch.select("pixel", "wet")), "seen")  # read twice below
    wet = sieve(seen.where("wet").join(static, "pixel").select("pixel", "row", "col"), 3).select("pixel", F.lit(True).alias("kept"))
    px = static.join(wet, "pixel", "left").withColumn("wet", F.coalesce("kept", F.lit(False)))
    rows = zone_rows(zone_area(px), floor).join(coverage(seen, static), "zone", "left")
    flagged = rows.where("flagged").select("zone", "km2")
    header = batch.agg(F.max("day").cast("string").alias("latest"), F.countDistinct("day").alias("passes"))
    return publish_snapshot(header, rows.select(F.col("zone").cast("string").alias("zone"), "km2", "coverage"), render_alerts(flagged, templates), floor)


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Events that monitor_step has kept, by batch and day."""
    schema = "event_id long, pixel long, wet boolean, batch long, day date"
    return spark.read.schema(schema).option("basePath", f"{path}/arrivals").parquet(f"{path}/arrivals")


def keep_arrivals(batch: DataFrame, number: int, path: str, days: int) -> bool:
    """Keep what a batch brings that is not known yet, by batch and day; True if it has a day. Ids are
    compared here, once for each arrival, so that readers need not: of events with one id less than
    `days` days outside of the batch's days the first stands."""
    first, last = batch.agg(F.min("day"), F.max("day")).first()
    new = batch.select("event_id", "pixel", "day", "wet").dropDuplicates(["event_id"])
    if number:
        near = F.col("day").between(F.date_sub(F.lit(first), days - 1), F.date_add(F.lit(last), days - 1))
        known = arrivals(batch.sparkSession, path).where((F.col("batch") < number) & near).select(F.col("event_id").alias("_id"))
        new = new.join(known, F.col("event_id").eqNullSafe(F.col("_id")), "left_anti")
    new.write.mode("overwrite").partitionBy("day").parquet(f"{path}/arrivals/batch={number}")
    return last is not None


def monitor_step(batch: DataFrame, number: int, static: DataFrame | None, templates: DataFrame | None, path: str, floor: float = C.ALERT_KM2, days: int = C.WINDOW_DAYS) -> None:
    """R4 and R6, one batch of arrivals (event_id, pixel, day, wet). What arrived is kept by batch and day,
    each event once. The snapshot (where there are static layers) and the look-backs are worked out
    from all that is known, so that late scenes change what holds their day and repeated ones change nothing.
    All is written under the batch's number or in place of what it replaces: a batch that is run again,
    after it was written but before it was noted as done, leaves the same."""
    if not keep_arrivals(batch, number, path, days):
        return
    known = arrivals(batch.sparkSession, path).where(F.col("batch") <= number)
    if static is not None:
        last = known.agg(F.max("day")).first()[0]
        recent = known.where(F.col("day") > F.date_sub(F.lit(last), days))
        run_monitor(recent.select("pixel", "day", "wet"), static, templates, floor).write.mode("overwrite").text(f"{path}/snapshots/batch={number}")
    # look-backs that hold a day of the batch start at most days - 1 before it
    own = known.where(F.col("batch") == number).agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    if own.last is None:
        return
    near = known.where(F.col("day").between(F.date_sub(F.lit(own.first), days - 1), F.date_add(F.lit(own.last), days - 1)))
    changed = known.where(F.col("batch") == number).select("day").distinct().select(F.explode(F.sequence(F.date_sub("day", days - 1), "day")).alias("start")).distinct()
    per = near.groupBy("day").agg(F.count("*").alias("n"), F.count_if("wet").alias("wet"))
    back = per.select(F.explode(F.sequence(F.date_sub("day", days - 1), "day")).alias("start"), "n", "wet").join(changed, "start", "left_semi")
    back = back.groupBy("start").agg(F.sum("n").alias("n"), F.sum("wet").alias("wet"))
    back.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("start").parquet(f"{path}/lookback")


def run_batches(stream: DataFrame, static: DataFrame | None, templates: DataFrame | None, path: str, floor: float = C.ALERT_KM2, days: int = C.WINDOW_DAYS) -> None:
    """All that has arrived since the last call, batch after batch; restarts go on from the checkpoint
    beside the tables. Without static layers only look-backs are kept up to date."""
    drain(stream, f"{path}/checkpoint", lambda df, i: monitor_step(df, i, static, templates, path, floor, days))


def last_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The JSON text of the latest batch that has one."""
    s = spark.read.schema("value string, batch long").option("basePath", f"{path}/snapshots").text(f"{path}/snapshots")
    return s.groupBy().agg(F.max_by("value", "batch").alias("value"))


def stream_fresh(stream: DataFrame) -> DataFrame:
    """R5. Each pixel's first wet day: in update mode a row for every pixel that a batch finds wet."""
    return stream.where("wet").groupBy("pixel").agg(F.min("day").alias("day"))


def lookback(stream: DataFrame) -> DataFrame:
    """R6. Sliding ten-day look-backs by day; late scenes change all that hold their day."""
    w = stream.withWatermark("ts", "12 days") if stream.isStreaming else stream
    return w.groupBy(F.window("ts", "10 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("wet")).select(F.to_date("w.start").alias("start"), "n", "wet")


def rewrite_last_days(table: DataFrame, path: str, days: int = 10) -> None:
    """R6. The last days are always written anew: dynamic overwrite of their partitions only."""
    last = table.agg(F.max("day").alias("last"))
    recent = table.crossJoin(F.broadcast(last)).where(F.datediff("last", "day") < days).drop("last")
    recent.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def observed_so_far(px: DataFrame, static: DataFrame, start: str, before: str, today: str) -> DataFrame:
    """R7. Extent of the current window up to today, and the fraction of the window before it."""
    from riverlens.operators.composites import union_masks
    from riverlens.operators.zonal import zone_area

    d = F.col("day")
    lit = lambda x: F.to_date(F.lit(x))

    def area(rows: DataFrame, name: str) -> DataFrame:
        u = static.join(union_masks(rows), "pixel", "left")
        return zone_area(u).select("zone", F.col("flooded_ha").alias(f"{name}_ha"), F.col("fraction").alias(f"{name}_fraction"))

    now = area(px.where((d >= lit(start)) & (d <= lit(today))), "observed")
    return now.join(area(px.where((d >= lit(before)) & (d < lit(start))), "antecedent"), "zone", "left")


def wet_sessions(stream: DataFrame) -> DataFrame:
    """R8. Runs of wet passes of a pixel with gaps of at most four days."""
    wet = stream.where("event_type = 'error'")
    wet = wet.withWatermark("ts", "12 days") if wet.isStreaming else wet
    g = wet.groupBy(F.session_window("ts", "4 days").alias("s"), F.col("user_id").alias("pixel"))
    return g.agg(F.count("*").alias("n")).select("pixel", F.col("s.start").alias("first"), F.col("s.end").alias("until"), "n")


def publish_or_degrade(spark: SparkSession, make: Callable[[], DataFrame], schema: str) -> DataFrame:
    """R9. What make() publishes, or one row of NULLs of the same schema with the reason when a
    source fails, be it missing or broken while it is read: the result is written before it is
    published. The reason is the error's class and first line."""
    try:
        out, path = make(), scratch(spark, "published")
        out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path).withColumn("degraded", F.lit(None).cast("string"))
    except Exception as e:
        said = next((x.strip() for x in str(e).splitlines() if x.strip()), "")
        empty = spark.createDataFrame([()], "struct<>").select(*(F.lit(None).cast(t).alias(n) for n, t in (x.strip().split(" ", 1) for x in schema.split(","))))
        return empty.withColumn("degraded", F.lit(f"{type(e).__name__}: {said}"))


#: The sources of a nowcast.
SOURCES = ("rain", "reservoirs", "labels")


def nowcast_snapshot(zones: DataFrame, header: DataFrame, sources: dict[str, str], observed: DataFrame | None = None, scores: DataFrame | None = None, notes: str = "") -> DataFrame:
    """R9. One JSON text of the locked form: generated_utc, window_start, window_end, core_season, activates,
    sources, districts, notes. header: one row with the first five. Every zone is there with its score
    and what was observed, NULL where either is missing, in T5's order: by score in the core season,
    by area before. Zones are administrative units, so the array stays small."""
    none = lambda kind: F.lit(None).cast(kind)
    z = zones.select("zone").distinct()
    z = z.join(observed.select("zone", "observed_fraction_window", "observed_km2"), "zone", "left") if observed is not None else z.withColumns({"observed_fraction_window": none("double"), "observed_km2": none("double")})
    z = z.join(scores.select("zone", F.col("p_event").alias("_p")), "zone", "left") if scores is not None else z.withColumn("_p", none("double"))
    z = z.crossJoin(F.broadcast(header.select("core_season"))).withColumn("p_event", F.when(F.col("core_season"), F.col("_p")))
    place = F.struct(F.coalesce(-F.col("p_event"), F.lit(1.0)), -F.coalesce("observed_km2", F.lit(0.0)), F.col("zone"))
    one = F.struct(place.alias("place"), F.struct(F.col("zone").alias("district"), "p_event", "observed_fraction_window", "observed_km2").alias("d"))
    listed = z.agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["d"]).alias("districts"))
    said = F.create_map(*(F.lit(x) for k in SOURCES for x in (k, sources.get(k, "unavailable"))))
    out = header.crossJoin(F.broadcast(listed)).select("generated_utc", "window_start", "window_end", "core_season", "activates", said.alias("sources"), "districts", F.lit(notes).alias("notes"))
    return out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def publish_nowcast(zones: DataFrame, header: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """R9. What make() gives, or if a source fails, even while it is read, the same form with every
    zone, NULLs, all sources unavailable and a note that begins with DEGRADED."""
    out = publish_or_degrade(zones.sparkSession, make, "value string")
    reason = out.select("degraded").first()[0]
    return out.select("value") if reason is None else nowcast_snapshot(zones, header, {}, notes=f"DEGRADED: {reason}")
