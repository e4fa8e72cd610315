"""Forecast models fitted across all underlyings with distributed MLlib learners.

One model per split (and surface factor) is trained on the rows of every underlying, so the
fit itself is a Spark job and no group has to fit into one task. Boosted trees are grown per
principal factor of the log surface; the multi-output forest is in ``forest``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.sqlmath import exp_back
from optionlake.operators.features import FeatureSettings
from optionlake.operators.forecast import checked_predictions, config_hash, training_rows
from optionlake.operators.splits import split_id

LEARNERS = {
    "boosted": lambda params: GBTRegressor(
        maxIter=int(params.get("n_estimators", 50)), maxDepth=int(params.get("max_depth", 5)),
        stepSize=float(params.get("learning_rate", 0.05)),
        minInstancesPerNode=int(params.get("min_child_samples", 20)),
        featureSubsetStrategy=str(params.get("feature_fraction", "0.9")),
        validationIndicatorCol="is_validation", seed=int(params.get("random_state", 7))),
    "pooled_ridge": lambda params: LinearRegression(
        regParam=float(params.get("alpha", 1.0)), elasticNetParam=0.0),
    "pooled_elasticnet": lambda params: LinearRegression(
        regParam=float(params.get("alpha", 0.01)),
        elasticNetParam=float(params.get("l1_ratio", 0.1))),
}
EARLY_STOPPING = {"boosted"}


def _inverse_factors(scores: Column, components: list[list[float]], centre: list[float]) -> Column:
    """Factor scores back to a surface: centre plus the weighted components."""
    basis = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in components])
    middle = F.array(*[F.lit(float(v)) for v in centre])
    return F.transform(basis, lambda row, i: F.get(middle, i) + F.aggregate(
        F.zip_with(row, scores, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))


def fit_split(rows: DataFrame, members: DataFrame, number: int, model_name: str,
              params: dict, n_factors: int) -> DataFrame:
    """Train one split's factor models on all underlyings and predict its test dates."""
    here = members.filter(F.col("split_no") == number).select(*N.DAY, "role")
    split = rows.join(here, list(N.DAY), "inner").select(
        *N.DAY, N.TARGET_DATE, N.DECISION_TS, N.TARGET_TS, *N.SURFACE_IDS, "role",
        array_to_vector("x").alias("raw_features"), array_to_vector("log_y").alias("surface"))
    fit_rows = split.filter("role <> 'test'")
    early = model_name in EARLY_STOPPING
    basis_rows = fit_rows.filter("role = 'train'") if early else fit_rows
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True,
                            withStd=True).fit(basis_rows)
    centring = StandardScaler(inputCol="surface", outputCol="centred", withMean=True,
                              withStd=False).fit(basis_rows)
    pca = PCA(k=n_factors, inputCol="centred", outputCol="factors").fit(
        centring.transform(basis_rows))
    ready = pca.transform(centring.transform(scaler.transform(fit_rows))).select(
        "features", vector_to_array("factors").alias("factors"),
        (F.col("role") == "validation").alias("is_validation")).persist(
        StorageLevel.MEMORY_AND_DISK)
    predicted = scaler.transform(split.filter("role = 'test'"))
    for k in range(n_factors):
        learner = LEARNERS[model_name](params).setLabelCol("label").setFeaturesCol(
            "features").setPredictionCol(f"factor_{k}")
        labelled = ready.withColumn("label", F.get("factors", F.lit(k)))
        predicted = learner.fit(labelled).transform(predicted)
    ready.unpersist()
    scores = F.array(*[F.col(f"factor_{k}") for k in range(n_factors)])
    surface = _inverse_factors(scores, pca.pc.toArray().tolist(), centring.mean.toArray().tolist())
    return predicted.select(
        N.SYMBOL, F.lit(model_name).alias("model_name"), N.DATE, N.TARGET_DATE,
        split_id(F.lit(number)).alias("split_id"), N.DECISION_TS, N.TARGET_TS, *N.SURFACE_IDS,
        config_hash(model_name, params).alias("model_config_hash"),
        checked_predictions(exp_back(surface)).alias("predictions"))


def pooled_forecasts(features: DataFrame, members: DataFrame, model_name: str, run_id: str,
                     params: dict | None = None, n_factors: int = 5,
                     numbers: Sequence[int] | None = None,
                     settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Walk-forward forecasts of a pooled learner on the given splits, by default all.

    `members` are the memberships of the walk-forward splits, best a written table because
    every split filters it. The driver walks over splits
    and factors only, whose number is fixed by the calendar; every fit is a distributed job.
    """
    rows = training_rows(features, settings)
    if numbers is None:
        numbers = range(members.agg(F.max("split_no")).first()[0] + 1)
    made = [fit_split(rows, members, number, model_name, dict(params or {}), n_factors)
            for number in numbers]
    result = made[0]
    for part in made[1:]:
        result = result.unionByName(part)
    columns = [c for c in result.columns if c not in ("predictions",)]
    return result.select(*columns, F.lit(run_id).alias("training_run_id"), "predictions")
