"""Learned fusion with Spark ML: classifiers and regressors chosen on an inner validation part, and their importances."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.metrics import errors, roc_auc
from matchloom.operators.splits import class_weight, stratified_holdout

#: The features of a pair, and the subsets of the ablation.
FEATURES = ["tfidf_cosine", "bm25_score", "embedding_cosine", "dp_embedding_cosine", "kg_skill_coverage", "skill_overlap_count", "missing_skill_ratio", "requirement_coverage", "resume_length", "jd_length"]
KG_FEATURES = ["kg_skill_coverage", "skill_overlap_count", "missing_skill_ratio", "requirement_coverage"]
NON_DP_FEATURES = [f for f in FEATURES if f != "dp_embedding_cosine"]
NO_KG_FEATURES = [f for f in FEATURES if f not in KG_FEATURES]

CLASSIFIERS = ("LogisticRegression", "RandomForest", "GradientBoosting")
REGRESSORS = ("Ridge", "RandomForest", "GradientBoosting")


def _classifier(name: str, seed: int, weight_sum: float, small: bool) -> Any:
    shared = {"featuresCol": "features", "labelCol": "_y", "weightCol": "_w"}
    if name == "LogisticRegression":  # one over the sum of weights is an inverse penalty of 1
        return LogisticRegression(**shared, maxIter=1000, regParam=1.0 / max(1.0, weight_sum), elasticNetParam=0.0, standardization=False, tol=1e-8)
    if name == "RandomForest":
        return RandomForestClassifier(**shared, numTrees=30 if small else 80, maxDepth=5 if small else 6, minInstancesPerNode=3, seed=seed)
    if name == "GradientBoosting":
        return GBTClassifier(**shared, maxIter=10 if small else 50, maxDepth=3 if small else 4, seed=seed)
    raise ValueError(f"unknown classifier: {name}")


def _regressor(name: str, seed: int, spread: float, rows: int, small: bool) -> Any:
    shared = {"featuresCol": "features", "labelCol": "_y"}
    if name == "Ridge":  # the penalty counts relative to the label's spread
        return LinearRegression(**shared, regParam=spread / max(1, rows), elasticNetParam=0.0, standardization=False, solver="normal")
    if name == "RandomForest":
        return RandomForestRegressor(**shared, numTrees=30 if small else 80, maxDepth=5 if small else 6, minInstancesPerNode=3, seed=seed)
    if name == "GradientBoosting":
        return GBTRegressor(**shared, maxIter=10 if small else 50, maxDepth=3 if small else 4, seed=seed)
    raise ValueError(f"unknown regressor: {name}")


def _fit(stage: Any, train: DataFrame, features: list[str]) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"), stage]).fit(train)


def _doubles(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def train_classifier(train: DataFrame, features: list[str], label: str, seed: int, row_id: str, models: tuple[str, ...] = CLASSIFIERS, small: bool = False) -> tuple[str, PipelineModel]:
    """The model with the best AUC on a stratified quarter of ``train`` (the earlier wins ties), fitted again on all of it.

    A single name is fitted at once. Rows weigh inversely to their class. With one class, or under 20 rows, all
    rows serve for fitting and validation.
    """
    counts = {int(r[label]): r["count"] for r in train.groupBy(label).count().collect()}
    rows = _doubles(train, features).withColumn("_y", F.col(label).cast("double")).withColumn("_w", class_weight(F.col(label), counts)).persist()
    total = float(sum(counts.values()))
    try:
        chosen = models[0]
        if len(models) > 1:
            split = stratified_holdout(rows, row_id, label, 0.25, [seed], "inner")
            inner, valid = split.where(~F.col("is_test")), split.where("is_test")
            if total < 20 or min(counts.values()) < 2:
                inner = valid = rows
            best = -1.0
            for name in models:
                model = _fit(_classifier(name, seed, total * 0.75, small), inner, features)
                auc = roc_auc(with_probability(model, valid, "score").withColumn("label", F.col(label)), []).first()
                found = float(auc["auc"]) if auc and auc["auc"] is not None else 0.0
                if found > best:
                    chosen, best = name, found
        return chosen, _fit(_classifier(chosen, seed, total, small), rows, features)
    finally:
        rows.unpersist()


def train_regressor(train: DataFrame, features: list[str], target: str, seed: int, row_id: str, models: tuple[str, ...] = REGRESSORS, small: bool = False) -> tuple[str, PipelineModel]:
    """The model with the smallest error on a quarter of ``train``, fitted again on all of it."""
    rows = _doubles(train, features).withColumn("_y", F.col(target).cast("double")).withColumn("_one", F.lit(1)).persist()
    try:
        stats = rows.agg(F.stddev_pop("_y").alias("s"), F.count("*").alias("n")).first()
        spread, n = float(stats["s"] or 0.0), stats["n"]
        chosen = models[0]
        if len(models) > 1:
            split = stratified_holdout(rows, row_id, "_one", 0.25, [seed], "inner")
            inner, valid = split.where(~F.col("is_test")), split.where("is_test")
            best = float("inf")
            for name in models:
                model = _fit(_regressor(name, seed, spread, int(n * 0.75), small), inner, features)
                rmse = errors(model.transform(_doubles(valid, features)), [], "prediction", "_y").first()["rmse"]
                if rmse is not None and rmse < best:
                    chosen, best = name, rmse
        return chosen, _fit(_regressor(chosen, seed, spread, n, small), rows, features)
    finally:
        rows.unpersist()


def _features_of(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def with_probability(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """``out``: the probability of class 1."""
    scored = model.transform(_doubles(df, _features_of(model)))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def with_prediction(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    return model.transform(_doubles(df, _features_of(model))).withColumnRenamed("prediction", out).drop("features")


def feature_importance(model: PipelineModel, boosting_zeros: bool = False) -> dict[str, float]:
    """Tree importances, else absolute coefficients; zeros for boosted trees if ``boosting_zeros``."""
    names, last = _features_of(model), model.stages[-1]
    if boosting_zeros and "GBT" in type(last).__name__:
        return dict.fromkeys(names, 0.0)
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return dict(zip(names, map(float, values), strict=True))
