"""Quality metrics as aggregations: every function takes long rows and returns a row for each combination of ``keys``.

Undefined values are null, never NaN. Scores should be rounded (to 9 places, say) before they come here, so that ties are ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import ratio
from matchloom.operators.running import running_sums


def minmax_all(df: DataFrame, keys: list[str], scores: dict[str, str]) -> DataFrame:
    """Each of ``scores`` (name: new name) scaled to [0, 1] within ``keys``; where the ends are equal but for rounding it is 0.

    One aggregation and one join for all of them: scaling columns one after the other would read ``df`` twice for each.
    """
    names = list(scores)
    span = df.groupBy(*keys).agg(*(f(n).alias(f"_{e}{i}") for i, n in enumerate(names) for f, e in ((F.min, "lo"), (F.max, "hi"))))
    joined = df.join(span, keys) if keys else df.crossJoin(F.broadcast(span))  # without keys, one row
    out = {}
    for i, n in enumerate(names):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        flat = F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(hi)
        out[scores[n]] = F.when(flat, 0.0).otherwise(F.try_divide(F.col(n) - lo, hi - lo))
    return joined.withColumns(out).drop(*(f"_{e}{i}" for i in range(len(names)) for e in ("lo", "hi")))


def minmax(df: DataFrame, keys: list[str], score: str, out: str) -> DataFrame:
    return minmax_all(df, keys, {score: out})


def _by_score(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Positives and negatives at each distinct score."""
    return df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))


def roc_auc(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``auc``: the chance that a positive outscores a negative, ties counting half; null unless both classes occur."""
    ranked = running_sums(_by_score(df, keys, score, label), keys, score, ["n"])
    won = F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2))
    return ranked.groupBy(*keys).agg(F.try_divide(won.cast("double"), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def average_precision(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``average_precision``: the step-wise sum of precision times gained recall, tied scores together; null without positives."""
    falling = _by_score(df, keys, score, label).withColumn("down", -F.col(score))
    ranked = running_sums(falling, keys, "down", ["p", "n"])
    gained = F.sum(F.col("p") * F.try_divide(F.col("p_upto").cast("double"), (F.col("p_upto") + F.col("n_upto")).cast("double")))
    return ranked.groupBy(*keys).agg(F.try_divide(gained, F.sum("p").cast("double")).alias("average_precision"))


def confusion(df: DataFrame, keys: list[str], predicted: str = "predicted", label: str = "label") -> DataFrame:
    """Counts, accuracy, precision, recall, F1 (0 where undefined) and balanced accuracy (mean recall of the classes that occur)."""
    hit = lambda p, y: F.count_if((F.col(predicted) == p) & (F.col(label) == y))
    counts = df.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fn"))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    recalls = F.filter(F.array(F.try_divide(tp.cast("double"), tp + fn), F.try_divide(tn.cast("double"), tn + fp)), lambda x: x.isNotNull())
    return counts.select(*keys, "tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                         ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(F.aggregate(recalls, F.lit(0.0), lambda s, x: s + x), F.size(recalls)).alias("balanced_accuracy"))


def errors(df: DataFrame, keys: list[str], predicted: str, target: str) -> DataFrame:
    """``mae`` and ``rmse``."""
    gap = F.col(predicted) - F.col(target)
    return df.groupBy(*keys).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def pearson_of(x: Column, y: Column) -> Column:
    """Correlation from moments; null where a side is constant (a plain correlation would divide by zero)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x).cast("double")
    vx, vy = n * F.sum(x * x) - F.sum(x) * F.sum(x), n * F.sum(y * y) - F.sum(y) * F.sum(y)
    tiny = lambda v, s: v <= 1e-12 * n * s
    return F.when(~(tiny(vx, F.sum(x * x)) | tiny(vy, F.sum(y * y))), F.try_divide(n * F.sum(x * y) - F.sum(x) * F.sum(y), F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))))


def with_average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``out``: the rank of ``value`` within ``keys``, ties sharing their mean rank."""
    tied = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranks = running_sums(tied, keys, value, ["_c"]).select(*keys, value, (F.col("_c_before") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(ranks, [*keys, value], "left")


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``pearson`` and ``spearman`` of two columns."""
    sound = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_average_rank(with_average_rank(sound, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(pearson_of(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"), pearson_of(F.col("_rx"), F.col("_ry")).alias("spearman"))


def mean_std(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``<m>_mean``, ``<m>_std`` (population, nulls and NaN left out) of each metric, and ``runs``; sorted by ``keys``."""
    clean = lambda m: F.when(~F.isnan(m), F.col(m))
    aggs = [f(clean(m)).alias(f"{m}_{name}") for m in metrics for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return df.groupBy(*keys).agg(*aggs, F.count("*").alias("runs")).orderBy(*keys)


def describe_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles (exact, interpolated) and max of ``value``."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), quartiles.alias("q"), F.max(value).alias("max")) \
        .select(*keys, "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max")
