"""Labels, regrids and neighbourhoods on pixel tables, all as equi-joins on integer cell keys."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverlens.session import saved, ship

#: Pixels of a side of the tiles in which connected parts are found.
TILE = 512


def cell_size(edges: DataFrame) -> float:
    """Twice the mean extent of an edge: then an edge lies in few cells, and few edges in one."""
    mean = edges.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0]
    return 2.0 * mean if mean else 1.0


def edge_cells(edges: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """cx, cy, zones: what decides the zones of a pixel in each of the cells. A zone has the edges of
    the cell, and what lies to the right of it: rings are closed, so all edges to the right together
    are crossed as often as the right ends of the edges over the cell's right side lie below. Ends in
    the cell's own band stay to be compared; those of lower bands are counted once for the cell."""
    at = lambda c: F.floor(c / size)
    e = edges.withColumns({"_x0": at(F.least("x1", "x2")), "_x1": at(F.greatest("x1", "x2")), "_y0": at(F.least("y1", "y2")), "_y1": at(F.greatest("y1", "y2"))})
    own = e.where("y1 <> y2").withColumn("cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("cy", F.explode(F.sequence("_y0", "_y1")))
    none_e, none_y = F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"), F.lit(None).cast("double")
    own = own.select("cx", "cy", "label", F.struct(*(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).alias("edge"), none_y.alias("end"), F.lit(0).alias("odd"))
    over = e.where("_x0 < _x1").withColumn("cx", F.explode(F.sequence("_x0", F.col("_x1") - 1)))
    over = over.select("cx", "label", F.when(F.col("x1") > F.col("x2"), F.col("y1")).otherwise(F.col("y2")).cast("double").alias("end"))
    # an end that two edges share counts twice, which is as good as not at all
    over = over.groupBy("cx", "label", "end").agg((F.count("*") % 2).alias("odd")).where("odd = 1").withColumn("cy", at(F.col("end")))
    ends = over.select("cx", "cy", "label", none_e.alias("edge"), "end", F.lit(0).alias("odd"))
    lower = over.groupBy("cx", "label", "cy").agg((F.count("*") % 2).alias("odd")).where("odd = 1").withColumnRenamed("cy", "_below")
    below = cells.join(lower, "cx").where("_below < cy").groupBy("cx", "cy", "label").agg((F.count("*") % 2).cast("int").alias("odd")).where("odd = 1")
    below = below.select("cx", "cy", "label", none_e.alias("edge"), none_y.alias("end"), "odd")
    zone = own.union(ends).join(cells, ["cx", "cy"], "left_semi").union(below).groupBy("cx", "cy", "label")
    zone = zone.agg(F.collect_list("edge").alias("edges"), F.collect_list("end").alias("ends"), F.max("odd").alias("odd"))
    return zone.groupBy("cx", "cy").agg(F.collect_list(F.struct("label", "odd", "edges", "ends")).alias("zones"))


def label_pixels(px: DataFrame, edges: DataFrame) -> DataFrame:
    """J4. px(pixel, x, y) with the label of the zone that holds the centre, 0 outside all. edges(label,
    x1, y1, x2, y2) are those of closed rings. A pixel meets the edges of its own cell only: it is
    inside a zone if an odd number of edges is crossed to its right. Of several zones the least label
    stands. The edge rule is half-open, so shared borders count once."""
    edges = saved(edges.select("label", "x1", "y1", "x2", "y2"), "edges")  # read four times below
    size = cell_size(edges)
    p = px.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    zones = edge_cells(edges, p.select("cx", "cy").distinct(), size)

    def inside(z):
        crosses = lambda e: ((e["y1"] <= F.col("y")) != (e["y2"] <= F.col("y"))) & (F.col("x") < e["x1"] + (F.col("y") - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))
        return (z["odd"] + F.size(F.filter(z["edges"], crosses)) + F.size(F.filter(z["ends"], lambda y: y <= F.col("y")))) % 2 == 1

    label = F.array_min(F.transform(F.filter("zones", inside), lambda z: z["label"]))
    return p.join(zones, ["cx", "cy"], "left").select(*px.columns, F.coalesce(label, F.lit(0)).alias("label"))


def assign_parent(px: DataFrame, sub: str = "sub", zone: str = "zone", area: str = "m2", least: float = 0.5) -> DataFrame:
    """J5. For each sub-zone the zone of largest overlap and its share; sub-zones mostly outside all
    zones go. Equal overlaps: the first zone by name or number."""
    pair = px.groupBy(sub, zone).agg(F.sum(area).alias("a"))
    whole = Window.partitionBy(sub)
    pair = pair.withColumn("total", F.sum("a").over(whole)).where(F.col(zone).isNotNull())
    pair = pair.withColumn("inside", F.sum("a").over(whole)).withColumn("rn", F.row_number().over(whole.orderBy(F.desc("a"), zone)))
    return pair.where((F.col("rn") == 1) & (F.col("inside") >= least * F.col("total"))).select(sub, F.col(zone).alias("parent"), (F.col("a") / F.col("total")).alias("share"))


def regrid_nearest(dst: DataFrame, src: DataFrame, value: str, ratio: float) -> DataFrame:
    """J6. dst(row, col) cells of `ratio` source cells each take the source cell at their centre."""
    at = lambda c: F.floor((F.col(c) + 0.5) * ratio).cast("long")
    s = src.select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return dst.withColumn("_r", at("row")).withColumn("_c", at("col")).join(s, ["_r", "_c"], "left").drop("_r", "_c")


def regrid_average(src: DataFrame, value: str, factor: int) -> DataFrame:
    """J7."""
    return src.groupBy(F.expr(f"row div {factor}").alias("row"), F.expr(f"col div {factor}").alias("col")).agg(F.avg(value).alias(value))


def regrid_population(src: DataFrame, value: str, dx: float, dy: float) -> DataFrame:
    """J8. Counts onto a grid shifted by a fraction of a cell: each cell gives its four targets
    bilinear parts, so totals are conserved."""
    parts = F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col"), F.lit((dy if i else 1 - dy) * (dx if j else 1 - dx)).alias("w")) for i in (0, 1) for j in (0, 1)))
    e = src.select(F.coalesce(F.col(value), F.lit(0.0)).alias("_v"), F.explode(parts).alias("p"))
    return e.groupBy("p.row", "p.col").agg(F.sum(F.col("_v") * F.col("p.w")).alias(value))


def _around(px: DataFrame, offsets: list[tuple[int, int]], *keep: str) -> DataFrame:
    """A row for each pixel and offset, at the neighbour's place."""
    o = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets)))
    return px.withColumn("_o", o).select((F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), *keep)


def offsets(connectivity: int = 8) -> list[tuple[int, int]]:
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    return near if connectivity == 8 else [(i, j) for i, j in near if not i * j]


def buffer(mask: DataFrame, k: int = 1, connectivity: int = 8) -> DataFrame:
    """N2. The mask (row, col) grown by k rings."""
    out = mask.select("row", "col").distinct()
    for _ in range(k):
        out = out.union(_around(out, offsets(connectivity))).distinct()
    return out


def frontier(mask: DataFrame, k: int = 1, connectivity: int = 8) -> DataFrame:
    """N2. The rings alone."""
    return buffer(mask, k, connectivity).join(mask.select("row", "col"), ["row", "col"], "left_anti")


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's connected part, of n nodes with links a-b."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        for root in (low[a], low[b]):  # only roots move, and all that point to them with them
            np.minimum.at(low, root, m)
        while (up := low[low]).tobytes() != low.tobytes():
            low = up
        apart = low[a] != low[b]
        a, b = a[apart], b[apart]
    return low


def _tile(table: pa.Table, near: list[tuple[int, int]]) -> pa.Table:
    """pixel, row, col, label of the pixels of one tile: label is the least pixel of its part in it."""
    pixel, row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("pixel", "row", "col"))
    order = np.argsort(pixel, kind="stable")
    pixel, row, col = pixel[order], row[order], col[order]
    wide = int(col.max() - col.min()) + 3
    key = (row - row.min()) * wide + (col - col.min() + 1)
    by_key = np.argsort(key, kind="stable")
    place = key[by_key]
    links = [(by_key[:-1][place[1:] == place[:-1]], by_key[1:][place[1:] == place[:-1]])]  # one place twice
    for i, j in near:
        if (i, j) > (0, 0):
            at = np.searchsorted(place, key + i * wide + j)
            hit = (at < len(place)) & (place[np.minimum(at, len(place) - 1)] == key + i * wide + j)
            links.append((np.flatnonzero(hit), by_key[at[hit]]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    return pa.table({"pixel": pixel, "row": row, "col": col, "label": pixel[_least(a, b, len(pixel))]})


def _roots(pairs: DataFrame) -> DataFrame:
    """(label, root): the least label reachable by pairs (a, b), both ways. Each round takes the least
    root around and then the root's root, and writes one table."""
    known = saved(pairs.select(F.col("a").alias("label"), F.col("a").alias("root")).distinct(), "roots")
    while True:
        near = pairs.join(known.select(F.col("label").alias("b"), "root"), "b").groupBy(F.col("a").alias("label")).agg(F.min("root").alias("near"))
        new = known.join(near, "label").withColumn("new", F.least("root", "near"))
        # a root that has a neighbour with a lower one hands that on to all that point to it
        hook = new.groupBy(F.col("root").alias("_r")).agg(F.min("new").alias("to"))
        new = new.join(hook, F.col("root") == F.col("_r")).select("label", F.col("root").alias("old"), F.least("new", "to").alias("root"))
        jump = new.select(F.col("label").alias("p"), F.col("root").alias("up"))
        new = saved(new.join(jump, F.col("root") == F.col("p")).select("label", "old", F.least("root", "up").alias("root")), "roots")
        known = new.drop("old")
        if new.where("old <> root").isEmpty():
            return known


def connected_labels(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """(pixel, row, col, label): the least pixel of each connected part of a mask(pixel, row, col).
    Parts are found inside of tiles of TILE x TILE pixels, one tile a group; pixels at the sides of
    tiles give pairs of labels, a row for each two parts that touch, and only these are joined over
    and over, in rounds that grow with the logarithm of the tiles that a part spans in practice."""
    near = offsets(connectivity)
    ship(mask.sparkSession)
    own = mask.select(*(F.col(c).cast("long").alias(c) for c in ("pixel", "row", "col")))
    tile = [F.floor(F.col(c) / TILE).alias(f"tile_{c}") for c in ("row", "col")]
    own = own.groupBy(*tile).applyInArrow(lambda t: _tile(t, near), "pixel long, row long, col long, label long")
    own = saved(own, "tiles")
    at_side = [F.pmod(c, F.lit(TILE)).isin(0, TILE - 1) for c in ("row", "col")]
    side = own.where(at_side[0] | at_side[1]).withColumns({f"t_{c}": F.floor(F.col(c) / TILE) for c in ("row", "col")})
    other = side.select("row", "col", F.col("label").alias("b"), F.col("t_row").alias("u_row"), F.col("t_col").alias("u_col"))
    pairs = _around(side, near, F.col("label").alias("a"), "t_row", "t_col").join(other, ["row", "col"]).where("t_row <> u_row or t_col <> u_col")
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    if pairs.isEmpty():
        return own
    return own.join(_roots(pairs), "label", "left").select("pixel", "row", "col", F.coalesce("root", "label").alias("label"))


def sieve(mask: DataFrame, n: int, connectivity: int = 8) -> DataFrame:
    """N1. The mask without parts of fewer than n pixels."""
    lab = connected_labels(mask, connectivity)
    big = lab.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= n)
    return lab.join(big, "label", "left_semi").select("pixel", "row", "col")


def slope(dem: DataFrame, size: float, value: str = "elev") -> DataFrame:
    """N3. Degrees from central differences, one-sided where a neighbour is missing."""

    def gradient(axis: str, other: str):
        w = Window.partitionBy(other).orderBy(axis)
        c, a, b = F.col(axis), F.col(value), F.col(value)
        up = F.when(F.lag(axis).over(w) == c - 1, F.lag(value).over(w))
        down = F.when(F.lead(axis).over(w) == c + 1, F.lead(value).over(w))
        both = up.isNotNull() & down.isNotNull()
        return F.when(both, (down - up) / (2 * size)).when(down.isNotNull(), (down - a) / size).when(up.isNotNull(), (b - up) / size).otherwise(0.0)

    g = dem.withColumn("_gx", gradient("col", "row")).withColumn("_gy", gradient("row", "col"))
    return g.withColumn("slope", F.degrees(F.atan(F.hypot("_gx", "_gy")))).drop("_gx", "_gy")


def or_pool(px: DataFrame, factor: int, value: str = "wet") -> DataFrame:
    """N4. bool_or of masks, max of classes."""
    kind = dict(px.dtypes)[value]
    agg = F.bool_or(value) if kind == "boolean" else F.max(value)
    return px.groupBy(F.expr(f"row div {factor}").alias("row"), F.expr(f"col div {factor}").alias("col")).agg(agg.alias(value))


def _medians(table: pa.Table, rows: tuple[int, int], cols: tuple[int, int], radius: float) -> pa.Table:
    """row, col, median of the pixels in [rows) x [cols), from those and the ones around them. Row after row
    the values under the disc are sorted, the missing ones last."""
    n = int(radius)
    row, col = (table.column(c).to_numpy() for c in ("row", "col"))
    grid = np.full((rows[1] - rows[0] + 2 * n, cols[1] - cols[0] + 2 * n), np.nan)
    grid[row - rows[0] + n, col - cols[0] + n] = table.column("v").to_numpy(zero_copy_only=False)
    own = (row >= rows[0]) & (row < rows[1]) & (col >= cols[0]) & (col < cols[1])
    row, col = row[own], col[own]
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    median = np.empty(len(row))
    bounds = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)] if len(row) else [0]  # a tile may have pixels around it only
    half = [(i, int(math.sqrt(radius * radius - i * i))) for i in range(-n, n + 1)]
    for a, b in itertools.pairwise(bounds):
        i, js = int(row[a]) - rows[0] + n, col[a:b] - cols[0] + n
        under = np.sort(np.concatenate([grid[i + d][js[:, None] + np.arange(-w, w + 1)] for d, w in half], axis=1), axis=1)
        known = (~np.isnan(under)).sum(axis=1)
        k = np.arange(len(js))
        median[a:b] = (under[k, np.maximum(known - 1, 0) // 2] + under[k, np.minimum(known // 2, under.shape[1] - 1)]) / 2
    return pa.table({"row": row, "col": col, "median": pa.array(median, mask=np.isnan(median))})


def focal_median(px: DataFrame, radius: float, value: str = "elev") -> DataFrame:
    """N5. Median over the disc around each pixel of the table; missing values (and NaN) don't count.
    Pixels go to their tile and, within the radius of its sides, to the next ones: what is shuffled
    grows with a tile's sides, not with the disc. A place holds one pixel."""
    ship(px.sparkSession)
    n, size = int(radius), max(TILE, int(radius) + 1)
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - n) / size), F.floor((F.col(c) + n) / size)))
    d = px.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v"))
    d = d.withColumn("_tr", near("row")).withColumn("_tc", near("col"))

    def run(key, table):
        r, c = (x.as_py() * size for x in key)
        return _medians(table, (r, r + size), (c, c + size), radius)

    return px.join(d.groupBy("_tr", "_tc").applyInArrow(run, "row long, col long, median double"), ["row", "col"])


def earliest_clear(points: DataFrame, looks: DataFrame, key: str = "point") -> DataFrame:
    """J10. The first usable look of each point; points without one keep a NULL."""
    ok = looks.where("usable").groupBy(key).agg(F.min_by(F.struct("date", "value"), F.struct("date", "value")).alias("l"))
    return points.join(ok, key, "left").select(key, F.col("l.date").alias("date"), F.col("l.value").alias("value"))


def count_or_zero(keys: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """J11. Absence is zero; case and white space do not matter."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    d = dim.select(norm(F.col(key)).alias("_k"), value)
    return keys.withColumn("_k", norm(F.col(key))).join(d, "_k", "left").select(key, F.coalesce(value, F.lit(0)).alias(value))


def best_common_orbit(scenes: DataFrame, orbit: str = "orbit") -> DataFrame:
    """J13. The orbit present in both phases with the best weaker count, then total, then name."""
    n = scenes.groupBy(orbit).agg(F.count_if(F.col("phase") == "pre").alias("pre"), F.count_if(F.col("phase") == "wet").alias("wet")).where("pre > 0 and wet > 0")
    return n.orderBy(F.desc(F.least("pre", "wet")), F.desc(F.col("pre") + F.col("wet")), orbit).limit(1)


def mercator_xy(lon, lat) -> tuple:
    """Web-Mercator easting and northing of degrees."""
    from riverlens.config import EARTH_RADIUS as R

    return F.radians(lon) * R, F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * R
