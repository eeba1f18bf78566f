"""Fused scores, their direction, and predictions. Methods, seeds and thresholds are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.metrics import minmax, minmax_all, roc_auc

#: The published fusion weights.
PAIR_WEIGHTS = {"dp": 0.45, "kg": 0.45, "bm25": 0.10}
RETRIEVAL_DP_WEIGHTS = {"dp": 0.55, "kg": 0.45}
RAG_WEIGHTS = {"tfidf": 0.35, "bm25": 0.25, "embedding": 0.20, "kg": 0.20}


def weighted_sum(weights: dict[str, float], suffix: str = "") -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.col(name + suffix)
    return total


def scaled_all(df: DataFrame, names: list[str], scope: list[str] | None = None) -> DataFrame:
    """``<name>_scaled`` of each score, within ``scope``: what several fusions of the same scores share."""
    return minmax_all(df, scope or [], {n: f"{n}_scaled" for n in names})


def fuse(df: DataFrame, weights: dict[str, float], out: str, scope: list[str] | None = None, scale: bool = True) -> DataFrame:
    """``out``: weighted sum of scores, each scaled to [0, 1] within ``scope`` first unless ``scale`` is off."""
    if not scale:
        return df.withColumn(out, weighted_sum(weights))
    return scaled_all(df, list(weights), scope).withColumn(out, weighted_sum(weights, "_scaled")).drop(*(f"{n}_scaled" for n in weights))


def largest(df: DataFrame, names: list[str], out: str, scope: list[str] | None = None) -> DataFrame:
    """``out``: the largest of some scaled scores, instead of a weighted sum."""
    return scaled_all(df, names, scope).withColumn(out, F.greatest(*(F.col(f"{n}_scaled") for n in names))).drop(*(f"{n}_scaled" for n in names))


def to_long(df: DataFrame, ids: list[str], methods: list[str], name: str = "method", value: str = "score") -> DataFrame:
    return df.unpivot(ids, methods, name, value)


def directions(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``keys, auc, auc_negated, direction``: -1 where the negated score separates the labels better. Undefined: 1."""
    return roc_auc(df, keys, score, label).select(*keys, "auc", (1 - F.col("auc")).alias("auc_negated"), F.when(F.col("auc") < 0.5, -1).otherwise(1).alias("direction"))


def oriented(df: DataFrame, by: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scores turned by ``directions`` of other rows (the training part) or of the same ones (in-sample: it sees the labels)."""
    return df.join(by.select(*keys, "direction"), keys, "left").withColumn(score, F.col(score) * F.coalesce("direction", F.lit(1))).drop("direction")


def predicted(df: DataFrame, keys: list[str], score: str = "score", threshold: float = 0.5) -> DataFrame:
    """``predicted``: 1 where the score, scaled within ``keys``, reaches ``threshold``."""
    return minmax(df, keys, score, "_scaled").withColumn("predicted", (F.col("_scaled") >= threshold).cast("int")).drop("_scaled")


def label_of(raw: Column, threshold: float | Column = 7.0) -> Column:
    """1 where a raw score reaches the threshold; null without one."""
    return (raw >= threshold).cast("int")


def raw_score(macro: Column, micro: Column) -> Column:
    """Mean of the scores that exist."""
    return F.coalesce((macro + micro) / 2, macro, micro)


def continuous(normalized: Column, raw: Column, label: Column) -> Column:
    """The target of regressions: the normalized score, else a tenth of the raw one, else the label."""
    return F.coalesce(normalized, raw / 10, label.cast("double"))


def score_column(df: DataFrame, epsilon: float, seed: int, fallback: bool = False) -> str:
    """Name of the private score for a budget and seed; another one only if ``fallback`` is asked for."""
    name = f"dp_embedding_cosine_epsilon_{str(float(epsilon)).replace('.', '_')}_seed_{seed}"
    if name in df.columns:
        return name
    if fallback and "dp_embedding_cosine" in df.columns:
        return "dp_embedding_cosine"
    raise KeyError(name)
