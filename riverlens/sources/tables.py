"""Scans, sources and sinks: declared schemas, checked columns, ordered products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverlens import config as C
from riverlens.session import ship
from riverlens.sources.geojson import PART_BYTES, GeoJsonSource, resolve


def require(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, required=()) -> DataFrame:
    """S1. A delimited table under a declared schema; a required column that the header lacks is an
    error before any action."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


ZONE_COLUMNS = {"zone": "zone", "flooded_ha": "flooded_ha", "area_ha": "area_ha", "year": "year", "window_start": "window_start"}


def tidy_zone_export(df: DataFrame, key: str = "ADM2_NAME") -> DataFrame:
    """S2. Required columns, zone key renamed, areas as double, fixed order."""
    require(df, [key, "year", "window_start", "flooded_ha", "area_ha"])
    return df.select(F.col(key).alias("zone"), F.col("year").cast("int").alias("year"), F.col("window_start").cast("date").alias("window_start"), F.col("flooded_ha").cast("double").alias("flooded_ha"), F.col("area_ha").cast("double").alias("area_ha"))


def read_pass_masks(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """S3. Day masks between two dates, from a table partitioned by season and day."""
    return spark.read.parquet(path).where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_features(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """properties, type, coordinates (JSON): a row for each feature of FeatureCollections, one file or a
    folder of them. A large file is cut at borders of features and read by many tasks; where only
    Spark's own readers reach a store, each file is one task."""
    try:
        resolve(path)
    except ValueError:
        schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
        raw = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
        return raw.select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    ship(spark)
    spark.dataSource.register(GeoJsonSource)
    return spark.read.format(GeoJsonSource.name()).option("bytes", part_bytes).load(path)


def read_polygons(spark: SparkSession, path: str, name_keys=("district", "DISTRICT", "NAME"), part_bytes: int = PART_BYTES) -> DataFrame:
    """S4. label, zone, part, ring, i, x1, y1, x2, y2: an edge table of a FeatureCollection, labels
    numbered by sorted name from 1. Polygons and multi-polygons; ring 0 is the shell."""
    raw = read_features(spark, path, part_bytes)
    name = F.coalesce(*(F.col("properties")[k] for k in name_keys))
    shape = "array<array<array<array<double>>>>"
    multi = F.when(F.col("type") == "Polygon", F.concat(F.lit("["), F.col("coordinates"), F.lit("]"))).otherwise(F.col("coordinates"))
    parts = raw.select(name.alias("zone"), F.from_json(multi, shape).alias("parts"))
    labels = parts.select("zone").distinct().withColumn("label", F.dense_rank().over(Window.orderBy("zone")))
    rings = parts.select("zone", F.posexplode("parts").alias("part", "rings")).select("zone", "part", F.posexplode("rings").alias("ring", "pts"))
    edges = rings.select("zone", "part", "ring", "pts", F.explode(F.sequence(F.lit(0), F.size("pts") - 2)).alias("i"))
    at = lambda k, j: F.expr(f"pts[i + {k}][{j}]")
    return edges.select("zone", "part", "ring", "i", at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(1, 0).alias("x2"), at(1, 1).alias("y2")).join(labels, "zone").select("label", "zone", "part", "ring", "i", "x1", "y1", "x2", "y2")


def filter_features(df: DataFrame, key: str, value, order: str) -> DataFrame:
    """S5."""
    return df.where(F.col(key) == value).orderBy(order)


def union_sources(*dfs: DataFrame) -> DataFrame:
    """S6. Tables with differing columns under one another; what a table lacks is NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def mask_fill(df: DataFrame, col: str = "mm") -> DataFrame:
    """S7. Negative fill values (and NaN) become NULL."""
    c = F.col(col)
    return df.withColumn(col, F.when(~F.isnan(c) & (c >= 0), c))


def read_rain_cells(spark: SparkSession, path: str) -> DataFrame:
    return mask_fill(spark.read.parquet(path))


def write_product(df: DataFrame, path: str, decimals: dict[str, int], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """S8. Fixed columns, rounding and sort; what was written is read back."""
    cols = columns or df.columns
    out = df.select(*(F.round(c, decimals[c]).alias(c) if c in decimals else F.col(c) for c in cols)).orderBy(*order)
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def publish_snapshot(header: DataFrame, zones: DataFrame, alerts: DataFrame | None = None, floor: float = C.ALERT_KM2, keys: tuple = ()) -> DataFrame:
    """S9. One JSON text for each row of the header (one run, or with keys one for each): its fields,
    the run's zones by area, those at or above the floor, alerts by language. Zones are
    administrative units, so the arrays stay small. Sources that are missing give empty arrays and
    NULL header fields."""
    own = [c for c in zones.columns if c not in keys]
    ranked = F.array_sort(F.collect_list(F.struct(*own)), lambda a, b: F.when(a["km2"] > b["km2"], -1).when(a["km2"] < b["km2"], 1).when(a["zone"] < b["zone"], -1).when(a["zone"] > b["zone"], 1).otherwise(0))
    z = zones.groupBy(*keys).agg(ranked.alias("zones"))
    out = header.join(z, list(keys), "left") if keys else header.crossJoin(F.broadcast(z))
    out = out.withColumn("zones", F.coalesce("zones", F.array().cast(z.schema["zones"].dataType))).withColumn("flagged", F.filter("zones", lambda x: x["km2"] >= floor))
    if alerts is not None:
        per = alerts.groupBy("lang").agg(F.sort_array(F.collect_list("text")).alias("texts")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "texts")))).alias("alerts"))
        out = out.crossJoin(F.broadcast(per))
    return out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def pending_days(calendar: DataFrame, ledger: DataFrame) -> DataFrame:
    """S10. Days of the calendar that the ledger lacks."""
    return calendar.join(ledger.select("day").distinct(), "day", "left_anti")


def append_ledger(done: DataFrame, path: str) -> None:
    done.write.mode("append").parquet(path)


def quantize_db(c) -> Column:
    """S11. round(dB * 100) in 16 bits, NULL as a sentinel."""
    c = F.col(c) if isinstance(c, str) else c
    clipped = F.least(F.greatest(F.round(c * 100), F.lit(-32767.0)), F.lit(32767.0))
    return F.when(c.isNull(), C.DB_NULL).otherwise(clipped).cast("smallint")


def dequantize_db(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != C.DB_NULL, c / 100.0)


def pixel_grid(spark: SparkSession, bbox: tuple[float, float, float, float], res: float) -> DataFrame:
    """S12. row, col, x, y of a north-up grid over (x0, y0, x1, y1), as a distributed range."""
    x0, y0, x1, y1 = bbox
    cols, rows = round((x1 - x0) / res), round((y1 - y0) / res)
    g = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("row"), F.expr(f"id % {cols}").alias("col"))
    return g.select("row", "col", (x0 + (F.col("col") + 0.5) * res).alias("x"), (y1 - (F.col("row") + 0.5) * res).alias("y"))


def lattice(spark: SparkSession, bbox: tuple[float, float, float, float], n: int) -> DataFrame:
    """S12. n x n sample points, the box's edges included."""
    x0, y0, x1, y1 = bbox
    step = max(1, n - 1)
    g = spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), F.expr(f"id % {n}").alias("j"))
    return g.select("i", "j", (x0 + F.col("j") * (x1 - x0) / step).alias("x"), (y0 + F.col("i") * (y1 - y0) / step).alias("y"))
