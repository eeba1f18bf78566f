"""Order-dependent sums without one task for all rows.

A window without a partition column sorts everything in one task. Here rows fall into buckets along the order, cut at approximate
quantiles so that no outlier fills one, the buckets' sums (at most ``BUCKETS`` rows a part) give each bucket its start, and rows are sorted
inside their bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A power of two.
BUCKETS = 256
_SHARES = "array(" + ", ".join(f"{i / BUCKETS}D" for i in range(1, BUCKETS)) + ")"
_STEPS = "array(" + ", ".join(str(BUCKETS >> i) for i in range(1, BUCKETS.bit_length())) + ")"


def running_sums(df: DataFrame, part: list[str], order: str, values: list[str]) -> DataFrame:
    """``df`` with ``<v>_before`` (sum over smaller ``order``) and ``<v>_upto`` (with its own row) for each of ``values``.

    ``order`` is numeric, not null, and unique within ``part``.
    """
    cuts = df.groupBy(*part).agg(F.expr(f"percentile_approx(`{order}`, {_SHARES}, {BUCKETS * 20})").alias("_cuts"))
    held = df.join(cuts, part) if part else df.crossJoin(F.broadcast(cuts))  # without parts, one row
    # A binary search: how many cuts are at most the row's own value.
    bucket = F.expr(f"aggregate({_STEPS}, 0, (at, step) -> if(_cuts[at + step - 1] <= `{order}`, at + step, at))")
    held = held.withColumn("_b", bucket).drop("_cuts")
    sums = held.groupBy(*part, "_b").agg(*(F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)))
    earlier = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*part, "_b", *(F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(len(values))))
    inside = Window.partitionBy(*part, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(starts, [*part, "_b"])
    for i, v in enumerate(values):
        out = out.withColumn(f"{v}_upto", F.col(f"_o{i}") + F.sum(v).over(inside)).withColumn(f"{v}_before", F.col(f"{v}_upto") - F.col(v))
    return out.drop("_b", *(f"_o{i}" for i in range(len(values))))


def digest(*key: Column) -> Column:
    """A hash that every engine has: the md5 of the parts, joined by bars."""
    return F.md5(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary"))


def shuffled_index(df: DataFrame, part: list[str], hash_col: str, tie: str) -> DataFrame:
    """``df`` with ``pos``: each row's place (from 0) in its part, in the order of a hexadecimal hash and then ``tie``.

    Buckets are the first three digits of the hash: 4096 sorts instead of one.
    """
    held = df.withColumn("_b", F.substring(hash_col, 1, 3))
    earlier = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy(*part, "_b").agg(F.count("*").alias("_n")).select(*part, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*part, "_b").orderBy(hash_col, tie)
    return held.join(starts, [*part, "_b"]).withColumn("pos", F.col("_o") + F.row_number().over(inside) - 1).drop("_b", "_o")
