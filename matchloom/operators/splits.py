"""Folds and hold-outs as columns. Random choices are orders of an md5 hash, so that any engine and partitioning repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.running import digest, shuffled_index

SEEDS = [3407, 42, 2026]
HOLDOUT_SEEDS = [3407, 42, 2026, 2027, 2028]
FOLDS = 5
#: Names of columns that can group records for grouped folds.
GROUP_COLUMNS = ("source", "source_file", "candidate_id", "profile_id", "filename_category", "lang", "user_id")


def fold_count(smallest_class: int, folds: int = FOLDS) -> int:
    """``folds``, or 2 to 3 where a class has fewer rows than that."""
    return folds if smallest_class >= folds else max(2, min(3, smallest_class))


def smallest_class(df: DataFrame, label: str) -> int:
    return df.groupBy(label).count().agg(F.min("count")).first()[0] or 0


def with_seeds(df: DataFrame, seeds: list[int]) -> DataFrame:
    """Each row once for each seed, as a column ``seed``."""
    return df.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))


def stratified_folds(df: DataFrame, row_id: str, label: str, folds: int = FOLDS, seeds: list[int] | None = None) -> DataFrame:
    """``seed, fold``: within each label rows are dealt out in turn, in hashed order, so class counts differ by one at most."""
    hashed = with_seeds(df, seeds or SEEDS).withColumn("_h", digest(F.col("seed"), F.col(row_id)))
    return shuffled_index(hashed, ["seed", label], "_h", row_id).withColumn("fold", (F.col("pos") % folds).cast("int")).drop("pos", "_h")


def stratified_holdout(df: DataFrame, row_id: str, label: str, share: float = 0.2, seeds: list[int] | None = None, salt: str = "holdout") -> DataFrame:
    """``seed, is_test``: the first ``round(share * n)`` rows of each label, in hashed order."""
    hashed = with_seeds(df, seeds or HOLDOUT_SEEDS).withColumn("_h", digest(F.lit(salt), F.col("seed"), F.col(row_id)))
    sizes = df.groupBy(label).agg(F.floor(F.count("*") * F.lit(share) + 0.5).alias("_k"))
    return shuffled_index(hashed, ["seed", label], "_h", row_id).join(sizes, label).withColumn("is_test", F.col("pos") < F.col("_k")).drop("pos", "_h", "_k")


def group_folds(df: DataFrame, group: str, folds: int = FOLDS, largest: int = 10_000) -> DataFrame | None:
    """``fold`` by group, so that no group is on both sides; None if there are too few groups or each row is its own.

    Groups go from the largest on to the fold that has fewest rows yet, ``largest`` of them through the driver. Further, smaller ones
    go where a hash says, which evens out as they are many. Rows without a group have no fold, and are left out.
    """
    sizes_all = df.where(F.col(group).isNotNull()).groupBy(group).count()
    told = sizes_all.agg(F.count("*").alias("groups"), F.max("count").alias("most")).first()
    if told["groups"] < folds or told["most"] == 1:
        return None
    sizes = [(r[group], r["count"]) for r in sizes_all.orderBy(F.desc("count"), group).limit(largest).collect()]
    load = [0] * folds
    placed = []
    for g, n in sizes:
        fold = load.index(min(load))
        load[fold] += n
        placed.append((g, fold))
    kind = dict(df.dtypes)[group]
    named = df.where(F.col(group).isNotNull()).join(F.broadcast(df.sparkSession.createDataFrame(placed, f"`{group}` {kind}, _fold int")), group, "left")
    return named.withColumn("fold", F.coalesce("_fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))).drop("_fold")


def group_columns(df: DataFrame) -> list[str]:
    return [c for c in GROUP_COLUMNS if c in df.columns]


def leaking_columns(features: list[str], targets: list[str], ids: list[str]) -> list[str]:
    """Features that are a target or an id, which must be none."""
    return sorted(set(features) & {*targets, *ids})


def class_weight(label: Column, counts: dict[int, int]) -> Column:
    """Balanced weights n / (2 * n_c)."""
    n = sum(counts.values())
    out = F.lit(1.0)
    for c, k in counts.items():
        out = F.when(label == c, n / (2.0 * max(1, k))).otherwise(out)
    return out
