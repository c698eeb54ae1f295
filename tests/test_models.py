"""Saved models and what guards them, permutation importance, the forest's outputs."""

import pytest
from pyspark.sql import functions as F

from riverlens.operators import forecast


@pytest.fixture(scope="module")
def panel(spark):
    d = spark.range(240).select(F.concat(F.lit("z"), F.col("id") % 8).alias("zone"), (1995 + F.floor(F.col("id") / 60)).cast("int").alias("year"), F.expr("date_add(date '2000-01-01', cast(id as int))").alias("window_start"), (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 11 > 0, F.rand(3)).alias("b"))
    return d.withColumn("y", (F.col("a") > 3).cast("double")).withColumn("truth", F.col("a") / 7)


@pytest.fixture(scope="module")
def saved(spark, panel, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('model')}/m"
    model, scores, _ = forecast.hindcast(panel, ["a", "b"], 1998, iterations=2, save_to=path)
    return path, model, scores


def test_saved_model_scores_alike(spark, panel, saved):
    path, model, scores = saved
    again = forecast.load_model(spark, path, ["a", "b"], before=1998)
    frame = panel.where("year = 1998").select("zone", "a", "b")
    a = sorted(map(tuple, forecast.score_live(model, frame, ["a", "b"], True).select("zone", "a", "b", "prob").collect()), key=repr)
    b = sorted(map(tuple, forecast.score_live(again, frame, ["a", "b"], True).select("zone", "a", "b", "prob").collect()), key=repr)
    assert a == b and len(a) == scores.count()
    assert {r.prob for r in forecast.score_live(again, frame, ["a", "b"], False).collect()} == {None}


@pytest.mark.parametrize("features, before", [(["b", "a"], None), (["a"], None), (["a", "b", "c"], None), (["a", "b"], 1997), (["a", "b"], 1990)])
def test_guard_refuses_other_models(spark, saved, features, before):
    """Another order, fewer or more features, or years that the scored ones are not after."""
    with pytest.raises(ValueError):
        forecast.load_model(spark, saved[0], features, before)


def test_guard_refuses_frames_in_another_order(panel, saved):
    with pytest.raises(ValueError):
        forecast.score_live(saved[1], panel.select("zone", "b", "a"), ["a", "b"], True)


def test_importance_does_not_depend_on_how_rows_are_dealt(panel, saved):
    d = forecast.typed(panel, ["a", "b"])
    one = {r.feature: r.importance for r in forecast.permutation_importance(saved[1], d.repartition(1), ["a", "b"]).collect()}
    many = {r.feature: r.importance for r in forecast.permutation_importance(saved[1], d.repartition(6), ["a", "b"]).collect()}
    assert one == pytest.approx(many) and one["a"] > 0.05 > abs(one["b"])
    plan = forecast.permutation_importance(saved[1], d, ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(zone" not in plan and "windowspecdefinition(md5" not in plan


def test_forest_gives_folds_importances_and_classes(spark):
    px = spark.range(300).select("id", F.when(F.col("id") % 50 > 0, (F.col("id") % 10).cast("double")).alias("f"), F.rand(1).alias("g"), (F.col("id") % 10 > 4).cast("double").alias("wet"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("basin"))
    _, folds, importances, predicted = forecast.train_pixel_classifier(px, ["f", "g"], "wet", "basin", trees=5)
    assert {r.fold: r.accuracy > 0.95 for r in folds.collect()} == {1: True, 2: True}
    imp = {r.feature: r.importance for r in importances.collect()}
    assert imp["f"] > imp["g"] and sum(imp.values()) == pytest.approx(1)
    rows = predicted.collect()  # all rows whose features are known
    assert len(rows) == 294 and all(r.predicted == int(r.f > 4) and 0 <= r.prob <= 1 for r in rows)
