"""Queries without SQL work on all of their input: all years, features and days."""

import os

import pytest

from riverlens.operators import forecast
from riverlens.plans import q_forecast, q_streaming, registry
from riverlens.streaming import monitor

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_monitor_is_fed_all_days(spark, monkeypatch):
    seen = set()

    def watched(df, *args):
        seen.update(r.day for r in df.select("day").distinct().collect())
        return run(df, *args)

    run = monitor.monitor_step
    monkeypatch.setattr(q_streaming.R, "monitor_step", watched)
    assert registry.QUERIES["r4_run_monitor"](spark, SF).collect()
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("to_date(ts) as day").where("day is not null").distinct()
    assert seen == {r.day for r in events.collect()}


def test_all_features_get_an_importance(spark):
    assert registry.QUERIES["m8_permutation_importance"](spark, SF).count() == len(forecast.FEATURE_ORDER)


def test_all_years_are_held_out(spark):
    years = {r.year for r in q_forecast.features(spark, SF).select("year").distinct().collect()}
    assert {r.year for r in registry.QUERIES["m5_loyo_oof"](spark, SF).select("year").distinct().collect()} == years
