"""Panels, folds, models and the live frame of the inundation forecaster."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlens.operators.evaluate import flag_sheet
from riverlens.operators.ordered import numbered, shuffled
from riverlens.operators.series import risk_rank
from riverlens.session import saved

#: Rain of two boxes over the window and the two before; mean storage and its change in three
#: reservoirs; the extent of the window before; the window's number; two priors of the zone.
RAIN = tuple(f"{box}{lag}" for lag in ("", "_lag1", "_lag2") for box in ("plain_mm", "upstream_mm"))
RESERVOIRS = tuple(f"dam{i}_{what}" for i in (1, 2, 3) for what in ("storage", "delta"))
PRIORS = ("prior_mean_ha", "prior_seasons_2pct")
FEATURE_ORDER = (*RAIN, *RESERVOIRS, "antecedent", "week", *PRIORS)


def with_missing_flags(df: DataFrame, features) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in features})


def estimator(features, label: str, kind: str, iterations: int = 300, depth: int = 4) -> Pipeline:
    """Medians for missing values (of the training rows), a flag for each, boosted trees."""
    imputed = [f"{c}_filled" for c in features]
    steps = [Imputer(inputCols=list(features), outputCols=imputed, strategy="median"), VectorAssembler(inputCols=[*imputed, *(f"{c}_missing" for c in features)], outputCol="x", handleInvalid="keep")]
    args = {"featuresCol": "x", "labelCol": label, "maxIter": iterations, "maxDepth": depth, "stepSize": 0.05, "subsamplingRate": 0.9, "seed": 42}
    return Pipeline(stages=[*steps, GBTClassifier(**args) if kind == "event" else GBTRegressor(**args)])


def typed(df: DataFrame, features) -> DataFrame:
    return with_missing_flags(df.withColumns({c: F.col(c).cast("double") for c in features}), features)


def score_event(model: PipelineModel, df: DataFrame) -> DataFrame:
    p = model.transform(df)
    return p.withColumn("prob", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction", *(c for c in p.columns if c.endswith("_filled")))


def loyo_oof(panel: DataFrame, features, years=None, iterations: int = 300, threads: int = 3, fraction: bool = True) -> DataFrame:
    """M5. Out-of-fold event probability and (unless left out) fraction for each held-out year. The folds are fitted in
    a small thread pool; each fit is a distributed job over the panel, which is written once, and
    each fold's scores are written when it is done."""
    d = saved(typed(panel, features), "panel")
    years = years or [r.year for r in d.select("year").distinct().orderBy("year").collect()]

    def fold(year: int) -> DataFrame:
        train, test = d.where(F.col("year") != year), d.where(F.col("year") == year)
        event = estimator(features, "y", "event", iterations).fit(train)
        out, pred = score_event(event, test), F.lit(None).cast("double")
        if fraction:
            out, pred = estimator(features, "truth", "fraction", iterations).fit(train).transform(out), F.col("prediction")
        return saved(out.select("zone", "year", "window_start", "y", "prob", "truth", pred.alias("pred")), "fold")

    with ThreadPoolExecutor(threads) as pool:
        return reduce(DataFrame.union, pool.map(fold, years))


def hindcast(panel: DataFrame, features, last: int, iterations: int = 300, save_to: str | None = None) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """M6. Fitted on the years before, scores of the last with ranks, and its flag sheet; the model can
    be saved with what it was fitted on."""
    d = saved(typed(panel, features), "panel")
    past = d.where(F.col("year") < last)
    model = estimator(features, "y", "event", iterations).fit(past)
    if save_to:
        save_model(model, save_to, features, [r.year for r in past.select("year").distinct().collect()])
    s = risk_rank(score_event(model, d.where(F.col("year") == last)))
    return model, s, flag_sheet(s.drop("risk_rank"))


#: Variants and the features that each does without.
VARIANTS = {"full": (), "no_reservoir": RESERVOIRS, "meteo_prior": (*RESERVOIRS, "antecedent")}


def variant_features(name: str) -> tuple[str, ...]:
    """M7. An unknown variant is a ValueError."""
    if name not in VARIANTS:
        raise ValueError(f"no variant {name}: {', '.join(VARIANTS)}")
    return tuple(c for c in FEATURE_ORDER if c not in VARIANTS[name])


def ablation_runs(panel: DataFrame, variants=tuple(VARIANTS), years=None, iterations: int = 300, threads: int = 3) -> DataFrame:
    """M7. variant, zone, year, window_start, y, prob: each variant fitted on the folds of M5 by its own
    features, and the fit-free baseline on the same rows."""
    d = saved(panel, "panel")
    out = [loyo_oof(d, variant_features(v), years, iterations, threads, fraction=False).select(F.lit(v).alias("variant"), "zone", "year", "window_start", "y", "prob") for v in variants]
    held = d if years is None else d.where(F.col("year").isin(list(years)))
    out.append(persistence(held).select(F.lit("persistence").alias("variant"), "zone", "year", "window_start", "y", "prob"))
    return reduce(DataFrame.union, out)


def persistence(df: DataFrame) -> DataFrame:
    """M7. The fit-free baseline: last window's fraction is the score."""
    return df.withColumn("prob", F.coalesce("antecedent", F.lit(0.0)))


def permutation_importance(model: PipelineModel, df: DataFrame, features, seed: int = 1, order=("zone", "window_start")) -> DataFrame:
    """M8. Rise of the Brier score when one column is dealt anew. Rows are numbered by ranges of their
    order and get the value of the row that a seeded bijection of the numbers names, another one for
    each column, so no window holds all rows and the result is the same however rows are dealt."""
    d = numbered(df, order, "_i")
    n = d.count()
    brier = F.avg(F.pow(F.col("y") - F.col("prob"), 2))
    base = score_event(model, df).agg(brier.alias("base"))
    out = []
    for k, c in enumerate(features):
        other = d.select(F.col("_i").alias("_of"), F.col(c).alias("_v"), F.col(f"{c}_missing").alias("_m"))
        dealt = d.withColumn("_of", shuffled(F.col("_i"), n, seed * 1000 + k))
        swapped = dealt.join(other, "_of").withColumns({c: F.col("_v"), f"{c}_missing": F.col("_m")}).drop("_i", "_of", "_v", "_m")
        out.append(score_event(model, swapped).agg(F.lit(c).alias("feature"), brier.alias("brier")))
    return reduce(DataFrame.union, out).crossJoin(F.broadcast(base)).select("feature", (F.col("brier") - F.col("base")).alias("importance"))


def save_model(model: PipelineModel, path: str, features, years) -> None:
    """M6. The model, and beside it what it was fitted on: features in order, years."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    said = spark.createDataFrame([(list(features), sorted(int(y) for y in years))], "features array<string>, years array<int>")
    said.write.mode("overwrite").json(f"{path}/fitted_on")


def load_model(spark: SparkSession, path: str, features, before: int | None = None) -> PipelineModel:
    """M10. A saved model, if it was fitted on just these features in this order, and (with `before`) on
    years before that one only; else ValueError."""
    said = spark.read.schema("features array<string>, years array<int>").json(f"{path}/fitted_on").first()
    if said is None or list(said.features) != list(features):
        raise ValueError(f"the model at {path} was fitted on other features: {said and said.features}")
    if before is not None and (not said.years or max(said.years) >= before):
        raise ValueError(f"the model at {path} knows years from {before} on: {said.years}")
    return PipelineModel.load(f"{path}/model")


def live_features(zones: DataFrame, scalars: DataFrame, antecedent: DataFrame, prior: DataFrame) -> DataFrame:
    """M9. One row a zone in the fixed feature order; missing is NULL. scalars is one row for the
    whole state (week, RAIN, RESERVOIRS), antecedent and prior (PRIORS) are by zone."""
    j = zones.select("zone").crossJoin(F.broadcast(scalars)).join(antecedent, "zone", "left").join(prior, "zone", "left")
    return j.select("zone", *FEATURE_ORDER)


def score_live(model: PipelineModel, frame: DataFrame, features, core: bool) -> DataFrame:
    """M10. Scores in the core season, NULL before; the columns must be the model's, in its order."""
    if [c for c in frame.columns if c in features] != list(features):
        raise ValueError("the features are not in the model's order")
    s = score_event(model, typed(frame, features))
    return s.withColumn("prob", F.when(F.lit(core), F.col("prob")))


def train_pixel_classifier(px: DataFrame, features, label: str, fold: str, trees: int = 200) -> tuple[PipelineModel, DataFrame, DataFrame, DataFrame]:
    """M4. Random forest: final model, accuracy of each spatial fold, importances, and the final model's
    class of every row of px. The rows are written once for all fits."""
    from riverlens.operators.evaluate import agreement_metrics, confusion

    px = saved(px, "pixels")
    steps = [VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="skip"), RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, seed=42)]
    names = [r[0] for r in px.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect()]
    rows = []
    for f in names:
        m = Pipeline(stages=steps).fit(px.where(F.col(fold) != f))
        t = m.transform(px.where(F.col(fold) == f)).select((F.col("prediction") == 1).alias("p"), (F.col(label) == 1).alias("t"))
        rows.append(agreement_metrics(confusion(t, "p", "t")).withColumn("fold", F.lit(f)))
    model = Pipeline(stages=steps).fit(px)
    imp = [(c, float(v)) for c, v in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)]
    wet = model.transform(px).select(*px.columns, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("prob"))
    return model, reduce(DataFrame.union, rows), px.sparkSession.createDataFrame(imp, "feature string, importance double"), wet


def fold_safe_prior(season: DataFrame) -> DataFrame:
    """M11. Repeat victims for each held-out year from all other years. A zone's years, of which there
    are few, stand in one row; both thresholds strict."""
    years = [r.year for r in season.select("year").distinct().orderBy("year").collect()]
    z = season.groupBy("zone").agg(F.collect_list(F.struct("year", "fraction", "flooded_ha")).alias("s"))
    z = z.withColumn("held_out", F.explode(F.array(*map(F.lit, years)))).withColumn("s", F.expr("filter(s, x -> x.year <> held_out)")).where(F.size("s") > 0)
    past = lambda t: F.expr(f"cast(size(filter(s, x -> x.fraction > {t})) as bigint)")
    known = "filter(transform(s, x -> x.flooded_ha), v -> v is not null)"
    mean = F.expr(f"try_divide(aggregate({known}, 0d, (a, v) -> a + v), size({known}))")
    return z.select("zone", "held_out", past(0.01).alias("seasons_1pct"), past(0.02).alias("seasons_2pct"), F.expr("array_max(transform(s, x -> x.fraction))").alias("max_fraction"), mean.alias("mean_ha"))


def zone_profile(methods: DataFrame, victims: DataFrame, people: DataFrame, peaks: DataFrame, subs: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """J15. All that is known of a zone: joined on the zone, with its sub-zones as a sorted array."""
    nested = subs.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("sub", "km2"))).alias("sub_zones"))
    j = methods
    for d in (victims, people, peaks, nested):
        j = j.join(d, "zone", "left")
    if override is not None:
        j = j.join(override.withColumnRenamed("value", "_o"), "zone", "left").withColumn("crop_ha", F.coalesce("_o", "crop_ha")).drop("_o")
    return j
