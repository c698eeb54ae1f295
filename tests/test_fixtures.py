"""Small cases with known answers: palettes, optical classes, confusion tables, stations, people, reports."""

import json

import pytest
from pyspark.sql import functions as F

from riverlens.functions import quality, scalars
from riverlens.operators import evaluate, forecast, zonal
from riverlens.streaming import monitor


def column(spark, rows, schema, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_palette_takes_its_colour_only(spark):
    pink = (229, 72, 117)
    rows = [(*pink, 255), (192, 0, 0, 255), (255, 118, 13, 255), (112, 173, 71, 255), (31, 119, 180, 255), (0, 0, 0, 0), (230, 74, 118, 220), (*pink, 10), (*pink, None)]
    got = column(spark, rows, "r int, g int, b int, a int", scalars.palette_class("r", "g", "b", "a", pink))
    assert got == [True, False, False, False, False, False, True, False, False]
    assert column(spark, [(*pink, 10)], "r int, g int, b int, a int", scalars.palette_class("r", "g", "b", "a", pink, alpha=1)) == [True]


def test_optical_index(spark):
    got = column(spark, [(0.12, 0.02), (0.08, 0.35), (0.0, 0.0), (None, 0.02)], "g double, n double", scalars.ndwi("g", "n"))
    assert got[0] == pytest.approx(0.1 / 0.14) and got[1] < 0 and got[2] is None and got[3] is None


def test_optical_classes(spark):
    rows = [(0.30, 6), (-0.30, 5), (0.02, 5), *[(0.4, c) for c in (8, 9, 3, 0)], (float("nan"), 5), (None, 5), (0.10, 5), (-0.05, 5)]
    got = column(spark, rows, "i double, c int", scalars.classify_water("i", "c", 0.10, -0.05))
    assert got == [1, 0, None, None, None, None, None, None, None, 1, 0]
    with pytest.raises(ValueError):
        scalars.classify_water("i", "c", -0.1, 0.1)


@pytest.mark.parametrize(
    "cells, want",
    [((2, 1, 1, 12), {"precision": 2 / 3, "recall": 2 / 3, "f1": 2 / 3, "iou": 0.5, "accuracy": 14 / 16}), ((0, 0, 0, 10), {"precision": 0, "recall": 0, "f1": 0, "iou": 0, "accuracy": 1}), ((0, 2, 3, 5), {"precision": 0, "recall": 0, "iou": 0})],
)
def test_agreement_of_exact_counts(spark, cells, want):
    tp, fp, fn, tn = cells
    rows = [(True, True, True)] * tp + [(True, False, True)] * fp + [(False, True, True)] * fn + [(False, False, True)] * tn + [(True, False, False)]
    c = evaluate.confusion(spark.createDataFrame(rows, "p boolean, t boolean, v boolean"), "p", "t", "v")
    assert tuple(c.select("tp", "fp", "fn", "tn").first()) == cells
    m = evaluate.agreement_metrics(c).first()
    assert {k: m[k] for k in want} == pytest.approx(want)


def test_people_are_conserved(spark):
    """A cell of 900 people, cut into a hundred smaller ones."""
    rows = [(900.0, 1e6), (float("nan"), 1e6), (float("inf"), 1e6), (None, 1e6), (-200.0, 1e6)]
    d = spark.createDataFrame(rows, "pop double, m2 double").select(scalars.to_density("pop", "m2", nodata=-200.0).alias("d"))
    assert [r.d for r in d.collect()] == [pytest.approx(9e-4), 0, 0, 0, 0]
    fine = d.limit(1).crossJoin(spark.range(100)).select(scalars.to_counts("d", F.lit(1e4)).alias("n"))
    assert fine.agg(F.sum("n")).first()[0] == pytest.approx(900)


def test_units(spark):
    rows = [(0.001, "Mha"), (0.023, " mha "), (105183.0, "ha"), (2.0, "lakh_ha"), (18.23, "crore_inr"), (35.0, "count")]
    got = column(spark, rows, "v double, u string", scalars.normalize_value("v", "u"))
    assert [tuple(g) for g in got] == [(pytest.approx(x), u) for x, u in [(1000, "ha"), (23000, "ha"), (105183, "ha"), (200000, "ha"), (18.23, "crore_inr"), (35, "count")]]
    for bad in ((1.0, "acres"), (-1.0, "ha"), (-5.0, "count"), (1.0, None)):
        with pytest.raises(Exception, match="no value and unit"):
            column(spark, [bad], "v double, u string", scalars.normalize_value("v", "u"))


def test_station_totals(spark):
    rows = [("a", 7, 7, 14), ("b", 2, 2, 5), ("c", 0, 1, 1), ("Total", 99, 99, 198)]
    bad = quality.check_totals(spark.createDataFrame(rows, "state string, level long, inflow long, total long"), ["level", "inflow"], "total", "state").collect()
    assert sorted((r.key, r.rule, r.found, r.declared) for r in bad) == [("Total", "total", 20.0, 198.0), ("b", "row", 4.0, 5.0)]
    s = spark.createDataFrame([("a", "level", True), ("a", "inflow", False), ("b", "level", None), (None, "level", True)], "state string, kind string, live boolean")
    got = {(r.state, r.kind): (r.stations, r.live) for r in zonal.network_totals(s).collect()}
    assert got[("Total", "Total")] == (4, 2) and got[("Total", "level")] == (3, 2) and got[("a", "Total")] == (2, 1) and got[("unknown", "level")] == (1, 1)


#: Hectares of wet land by zone, and of damaged crops as reported.
OURS = {
    "Firozpur": 14095.6, "Gurdaspur": 8099.2, "Kapurthala": 6596.6, "Tarn Taran": 6355.3, "Amritsar": 4594.3, "Jalandhar": 4130.2, "Moga": 2268.8, "Ludhiana": 1620.8, "Hoshiarpur": 1105.7, "Nawanshahr": 926.6,
    "Rupnagar": 806.8, "Patiala": 494.9, "Muktsar": 337.8, "Bathinda": 245.4, "Mansa": 180.6, "Sangrur": 164.4, "Sahibzada Ajit Singh Nagar": 92.3, "Faridkot": 54.3, "Barnala": 40.5, "Fatehgarh Sahib": 13.0,
}
REPORTED = {
    "Gurdaspur": 40169, "Amritsar": 27154, "Fazilka": 25182, "Patiala": 17690, "Kapurthala": 17574, "Ferozepur": 17257, "Tarn Taran": 12828, "Mansa": 12207.38, "Hoshiarpur": 8322, "Sangrur": 6560, "Jalandhar": 4800,
    "Pathankot": 2442, "Moga": 2240, "SAS Nagar": 2000, "Rupnagar": 1135, "Bathinda": 586.79, "Ludhiana": 189, "Nawanshahr": 188,
}


def test_reports_against_ours(spark):
    """Rank correlations 0.556 of the 16 named zones and 0.720 of all 20, after split zones are merged."""
    ours = spark.createDataFrame([(k, float(v)) for k, v in OURS.items()], "zone string, ours double")
    theirs = spark.createDataFrame([(k, float(v)) for k, v in REPORTED.items()], "zone string, theirs double")
    got = {r.variant: (r.n, r.rho) for r in evaluate.official_compare(ours, theirs).collect()}
    assert got["named"] == (16, pytest.approx(0.556, abs=5e-4)) and got["all"] == (20, pytest.approx(0.720, abs=5e-4))


def test_value_at_the_flat_yield(spark):
    rows = [("Firozpur", 11966.9, 1804608520.0), ("Kapurthala", 5542.0, 835733600.0), ("Fatehgarh Sahib", 7.3, 1100840.0)]
    assert column(spark, rows, "z string, ha double, want double", scalars.value_at_risk("ha")) == [pytest.approx(w) for *_, w in rows]


FIELDS = {"generated_utc", "window_start", "window_end", "core_season", "activates", "sources", "districts", "notes"}


def nowcast(spark, core, observed, scores, **more):
    header = spark.createDataFrame([("t", "2026-07-25", "2026-08-04", core, "2026-07-25")], "generated_utc string, window_start string, window_end string, core_season boolean, activates string")
    zones = spark.createDataFrame([("k",), ("f",), ("a",)], "zone string")
    o = spark.createDataFrame(observed, "zone string, observed_fraction_window double, observed_km2 double") if observed is not None else None
    p = spark.createDataFrame(scores, "zone string, p_event double") if scores else None
    return zones, header, lambda: monitor.nowcast_snapshot(zones, header, {"rain": "x", "labels": "y"}, o, p, **more)


def test_locked_nowcast(spark):
    seen = [("k", 0.0031, 8.2), ("f", 0.0009, 2.0), ("a", 0.0, 0.0)]
    early = json.loads(nowcast(spark, False, seen, [("a", 0.9)], notes="early")[2]().first().value)
    assert set(early) == FIELDS and [d["district"] for d in early["districts"]] == ["k", "f", "a"] and {d["p_event"] for d in early["districts"]} == {None}
    assert early["sources"] == {"rain": "x", "reservoirs": "unavailable", "labels": "y"} and early["core_season"] is False and early["notes"] == "early"
    core = json.loads(nowcast(spark, True, seen, [("a", 0.72), ("f", 0.5), ("k", 0.02)])[2]().first().value)
    assert [(d["district"], d["p_event"]) for d in core["districts"]] == [("a", 0.72), ("f", 0.5), ("k", 0.02)]
    bare = json.loads(nowcast(spark, False, [], None)[2]().first().value)
    assert [d["district"] for d in bare["districts"]] == ["a", "f", "k"] and all(d["observed_km2"] is None and d["observed_fraction_window"] is None for d in bare["districts"])


def test_degraded_nowcast_keeps_its_form(spark):
    zones, header, _ = nowcast(spark, True, None, None)
    for make in (lambda: spark.read.parquet("/no/such/table"), lambda: zones.select(F.raise_error(F.lit("boom")).alias("value"))):
        got = json.loads(monitor.publish_nowcast(zones, header, make).first().value)
        assert set(got) == FIELDS and set(got["sources"].values()) == {"unavailable"} and got["notes"].startswith("DEGRADED:")
        assert [d["district"] for d in got["districts"]] == ["a", "f", "k"] and all(v is None for d in got["districts"] for k, v in d.items() if k != "district")


def test_variants_are_fitted_on_the_same_folds(spark):
    cols = forecast.FEATURE_ORDER
    d = spark.range(160).select(F.concat(F.lit("z"), F.col("id") % 8).alias("zone"), (2000 + F.floor(F.col("id") / 80)).cast("int").alias("year"), F.expr("date_add(date '2000-01-01', cast(id as int))").alias("window_start"), *(F.rand(i).alias(c) for i, c in enumerate(cols)))
    d = d.withColumn("truth", F.col("dam1_storage")).withColumn("y", (F.col("truth") > 0.5).cast("double"))
    r = forecast.ablation_runs(d, iterations=2)
    assert {x.variant: x["count"] for x in r.groupBy("variant").count().collect()} == dict.fromkeys((*forecast.VARIANTS, "persistence"), 160)
    auc = {x.variant: x.roc_auc for x in evaluate.ablation_table(r).collect()}
    assert auc["full"] > 0.9 > 0.7 > auc["no_reservoir"]
