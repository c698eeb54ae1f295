"""GeoJSON read by many tasks: the same features wherever a file is cut."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from riverlens.sources import geojson, tables


def collection(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = float(i), float(i % 7)
        ring = [[x, y], [x + 1, y], [x + 1, y + 1 + r.random()], [x, y]]
        multi = i % 5 == 0
        props = {"district": f"zone {i % 11:02d}", "note": r.choice(['{"type": "Feature"', "a { b", 'quote " and \\ }{', "ünïcödé 漢字", None]), "nested": {"type": "no", "k": [1, {"x": "}"}]}, "n": i}
        out.append({"type": "Feature", "properties": props, "geometry": {"type": "MultiPolygon" if multi else "Polygon", "coordinates": [[ring]] if multi else [ring]}} if i % 3 else {"properties": props, "geometry": {"coordinates": [[ring]] if multi else [ring], "type": "MultiPolygon" if multi else "Polygon"}, "type": "Feature"})
    return {"type": "FeatureCollection", "name": "a {", "features": out}


@pytest.mark.parametrize("indent", [None, 1])
def test_every_feature_once_wherever_cut(indent):
    want = collection(40)
    data = json.dumps(want, ensure_ascii=False, indent=indent).encode()
    for size in (1, 2, 3, 7, 50, 333, 1000, len(data)) if indent is None else (97, 1234):
        cuts = range(0, len(data), size) if size > 40 else range(0, min(len(data), 3000), size)
        end = len(data) if size > 40 else cuts[-1] + size
        got = [f for a in cuts for f in geojson.features(io.BytesIO(data), a, a + size, len(data))]
        whole = list(geojson.features(io.BytesIO(data), 0, end, len(data)))
        assert got == whole
        if end >= len(data):
            assert got == want["features"]


def test_many_tasks_same_edges(spark, tmp_path):
    (tmp_path / "b.geojson").write_text(json.dumps(collection(300)))
    path = f"file://{tmp_path}/b.geojson"
    one = tables.read_polygons(spark, path)
    raw = tables.read_features(spark, path, 4_000)
    assert raw.rdd.getNumPartitions() > 10
    assert raw.count() == 300 and raw.where(F.size("properties") == 4).count() == 300
    many = tables.read_polygons(spark, path, part_bytes=4_000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert many.select("label", "zone").distinct().count() == 11
    assert {r.label for r in many.collect()} == set(range(1, 12))


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "b.geojson").write_text(json.dumps(collection(30)))
    path = f"file://{tmp_path}/b.geojson"
    want = sorted(map(tuple, tables.read_polygons(spark, path).collect()))

    def refuse(_):
        raise ValueError("no file system")

    monkeypatch.setattr(tables, "resolve", refuse)
    assert sorted(map(tuple, tables.read_polygons(spark, path).collect())) == want


def test_no_features(spark, tmp_path):
    (tmp_path / "e.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    assert tables.read_polygons(spark, str(tmp_path / "e.geojson")).count() == 0
