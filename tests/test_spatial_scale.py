"""Labels and neighbourhoods that have to hold at any number of edges, pixels and tiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlens.operators import spatial


def ring(points):
    return list(zip(points, [*points[1:], points[0]], strict=True))


def inside(x, y, edges):
    n = 0
    for (x1, y1), (x2, y2) in edges:
        if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            n += 1
    return n % 2 == 1


def zones():
    """Stars, one with a hole, a box on the grid, a thin sliver and a ring of very many edges."""
    r = random.Random(6)
    star = lambda x, y, k, big: ring([(x + math.cos(2 * math.pi * i / k) * big * r.uniform(0.4, 1), y + math.sin(2 * math.pi * i / k) * big * r.uniform(0.4, 1)) for i in range(k)])
    box = lambda x, y, w, h: ring([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    return {7: star(10.0, 10.0, 40, 9.0), 3: star(20.0, 12.0, 7, 8.0) + star(20.0, 12.0, 5, 1.0), 5: box(0.0, 0.0, 6.0, 4.0), 9: ring([(-5.0, -5.0), (40.0, 30.0), (40.0, 30.5)]), 2: star(-20.0, -20.0, 3000, 10.0)}


def frames(spark, points, shapes):
    px = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "pixel long, x double, y double")
    edges = spark.createDataFrame([(k, *a, *b) for k, es in shapes.items() for a, b in es], "label int, x1 double, y1 double, x2 double, y2 double")
    return px, edges


def test_labels_as_the_plain_rule(spark):
    shapes, r = zones(), random.Random(1)
    points = [(r.uniform(-35, 45), r.uniform(-35, 35)) for _ in range(3000)] + [(float(i), float(j)) for i in range(-2, 10) for j in range(-2, 8)] + [a for es in shapes.values() for a, _ in es[:20]]
    px, edges = frames(spark, points, shapes)
    got = {x.pixel: x.label for x in spatial.label_pixels(px, edges).collect()}
    want = {i: min((k for k, es in shapes.items() if inside(x, y, es)), default=0) for i, (x, y) in enumerate(points)}
    assert got == want


def test_a_pixel_meets_few_edges(spark):
    """With ten times the edges on the same ring, what a pixel is compared with does not grow."""
    worst = []
    for k in (500, 5000):
        shape = {1: ring([(math.cos(2 * math.pi * i / k) * 10, math.sin(2 * math.pi * i / k) * 10) for i in range(k)])}
        px, edges = frames(spark, [(x / 5, y / 5) for x in range(-60, 60) for y in range(-60, 60)], shape)
        size = spatial.cell_size(edges)
        cells = px.select(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).distinct()
        z = spatial.edge_cells(edges, cells, size).select(F.explode("zones").alias("z"))
        worst.append(z.agg(F.max(F.size("z.edges") + F.size("z.ends"))).first()[0])
    assert max(worst) <= 12, worst


def test_label_edge_cases(spark):
    px, edges = frames(spark, [(0.5, 0.5)], {4: ring([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])})
    assert spatial.label_pixels(px, edges.limit(0)).collect()[0].label == 0
    assert spatial.label_pixels(px.limit(0), edges).count() == 0
    assert spatial.label_pixels(px.withColumn("x", F.lit(None).cast("double")), edges).collect()[0].label == 0


def plain_labels(cells, near):
    seen = {}
    for start in sorted(cells, key=cells.get):
        if start in seen:
            continue
        todo = [start]
        while todo:
            c = todo.pop()
            if c not in seen:
                seen[c] = cells[start]
                todo += [d for i, j in near if (d := (c[0] + i, c[1] + j)) in cells]
    return {cells[c]: v for c, v in seen.items()}


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [3, 8, 512])
def test_parts_across_tiles(spark, monkeypatch, connectivity, tile):
    monkeypatch.setattr(spatial, "TILE", tile)
    r = random.Random(tile)
    cells = {(i - 5, j): None for i in range(24) for j in range(24) if r.random() < 0.5}
    cells |= {(50, j): None for j in range(60)} | {(50 + i, 60): None for i in range(20)}  # one long part
    ids = list(range(len(cells)))
    r.shuffle(ids)
    cells = dict(zip(cells, ids, strict=True))
    mask = spark.createDataFrame([(p, i, j) for (i, j), p in cells.items()], "pixel long, row long, col long")
    got = {x.pixel: x.label for x in spatial.connected_labels(mask, connectivity).collect()}
    assert got == plain_labels(cells, spatial.offsets(connectivity))


def test_least_on_long_paths():
    n = 5000
    order = np.random.default_rng(0).permutation(n)
    assert not spatial._least(order[:-1], order[1:], n).any()


def test_no_pixels(spark):
    assert spatial.connected_labels(spark.createDataFrame([], "pixel long, row long, col long")).count() == 0


@pytest.mark.parametrize("tile, radius", [(4, 1.5), (4, 3.0), (5, 7.2), (512, 2.0), (4, 0.5)])
def test_focal_median_as_plain(spark, monkeypatch, tile, radius):
    monkeypatch.setattr(spatial, "TILE", tile)
    r = random.Random(tile)
    cells = {(i - 6, j): r.choice([None, float(r.randint(0, 9)), r.random()]) for i in range(15) for j in range(15) if r.random() < 0.8}
    px = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "row long, col long, elev double")
    got = {(x.row, x.col): x.median for x in spatial.focal_median(px, radius).collect()}
    assert set(got) == set(cells)
    for (i, j), m in got.items():
        near = [v for (a, b), v in cells.items() if v is not None and (a - i) ** 2 + (b - j) ** 2 <= radius * radius]
        assert m is None if not near else m == pytest.approx(float(np.median(near)))


def test_focal_median_shuffles_few_rows(spark, monkeypatch):
    """With a disc of four times the cells, about as many rows go to the tiles."""
    monkeypatch.setattr(spatial, "TILE", 64)
    px = spark.range(128 * 128).select(F.expr("id div 128").alias("row"), F.expr("id % 128").alias("col"), F.rand(1).alias("elev"))
    sent = []
    was = spatial._medians
    for radius in (3.0, 6.0):
        near = lambda c, n=int(radius): F.explode(F.sequence(F.floor((F.col(c) - n) / 64), F.floor((F.col(c) + n) / 64)))
        sent.append(px.withColumn("a", near("row")).withColumn("b", near("col")).count())
        plan = spatial.focal_median(px, radius)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == 2
    assert was is spatial._medians and sent[1] < 1.25 * sent[0] < 1.6 * 128 * 128
