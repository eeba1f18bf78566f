"""Mixing sources to target weights by hash-threshold histograms: sums, thresholds and a filter, no sorting of rows.

1. each row's size and 60-bit hash are written once, without its text;
2. targets: sources share the budget by weight, capped at a multiple of their size (one small window over sources);
3. a source with target t and size s takes every document floor(t / s) times and has a rest of t left. The rest
   goes to the documents with the smallest hashes: a histogram of tokens by (source, hash bucket) finds the
   bucket where the rest runs out; all below it are taken, and only that bucket is refined, by
   the next digits of the hash, until no digits are left. Thresholds are nested: a larger rest takes a superset;
4. documents that share the last, full hash share what is left in proportion to their sizes.

All of it is DataFrame code: partial sums before every shuffle, so a hot source costs a bounded number of rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize

#: Hex digits of the hash, and how many each level of the histogram looks at.
DIGITS, LEVEL = 15, 3
#: A per-source table of up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space (space and U+0009 to U+000D); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_filled_targets(sources: DataFrame, budget_share: float, cap: float, weights: list[int]) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order, null last, get ``weights`` in turn. They share ``budget_share`` of all sizes;
    none gets over ``cap`` times its size, and what it gives up is shared again by weight. In the end every source
    below its cap has target = level * weight. Sources are capped in order of cap * size / weight, so one running
    sum finds the level: the first at which the next source stays below its cap.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", w.cast("double")).withColumn("ratio", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    filling = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(everything) * F.lit(float(budget_share)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", rest / open_weight)
    # From the first source that isn't capped on, the level stays.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return levels.withColumn("final", level).select(
        "source", "source_size", F.least(F.coalesce(F.col("final") * F.col("weight"), F.col("source_size") * F.lit(float(cap))), F.col("source_size") * F.lit(float(cap))).alias("target"))


def _named(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    digits = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, DIGITS)
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), digits.alias("digits")]


def mix_thresholds(sized: DataFrame, budget_share: float, cap: float, weights: list[int]) -> tuple[DataFrame, bool]:
    """``of, source_size, target, full, threshold, left, tokens``, a row a source, from ``source, size, digits``; and whether to broadcast it."""
    sources = materialize(water_filled_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), budget_share, cap, weights)
                          .withColumn("budget", F.floor("target")).withColumn("full", F.coalesce(F.try_divide("budget", "source_size").cast("long"), F.lit(0)))
                          .withColumn("rest", F.col("budget") - F.col("full") * F.col("source_size")), "sources")
    small = sources.count() <= BROADCAST_SOURCES
    # Thresholds: the digits fixed so far, and what is left of the budget for the documents that begin with them.
    marks = sources.select("source", F.lit("").alias("prefix"), F.col("rest").alias("left"))
    held = sized
    for at in range(1, DIGITS + 1, LEVEL):
        named = marks.select(F.col("source").alias("s"), "prefix", "left")
        inside = held.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("s")) & F.col("digits").startswith(F.col("prefix")))
        if at == 1 + LEVEL:  # the boundary buckets' rows, which are all that further levels look at
            inside = materialize(inside.select("source", "size", "digits", "prefix", "left"), "boundary")
            held = inside.select("source", "size", "digits")
        tokens = inside.groupBy("source", "prefix", "left", F.substring("digits", at, LEVEL).alias("bucket")).agg(F.sum("size").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        running = tokens.withColumn("upto", upto).where("upto > left")
        first = running.groupBy("source", "prefix").agg(F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("tokens")).alias("left"), "tokens")).alias("b"))
        marks = materialize(first.select("source", F.concat("prefix", "b.bucket").alias("prefix"), F.col("b.left").alias("left"), F.col("b.tokens").alias("tokens")), "marks")
    limits = sources.join(marks.select(F.col("source").alias("s"), F.col("prefix").alias("threshold"), "left", "tokens"), F.col("source").eqNullSafe(F.col("s")), "left") \
        .select(F.col("source").alias("of"), "source_size", "target", "full", "threshold", "left", "tokens")
    return limits, small


def _with_taken(sized: DataFrame, limits: DataFrame, small: bool) -> DataFrame:
    taken = F.when(F.col("threshold").isNull() | (F.col("digits") > F.col("threshold")), 0).when(F.col("digits") < F.col("threshold"), F.col("size")) \
        .otherwise(F.floor(F.col("size").cast("decimal(20,0)") * F.col("left") / F.col("tokens")).cast("long"))
    return sized.join(F.broadcast(limits) if small else limits, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("taken", F.col("full") * F.col("size") + taken)


def mix_sources(docs: DataFrame, budget_share: float = 1.5, cap: float = 2.0, weights: list[int] | None = None, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of every document the mix takes.

    Returns ``doc_id, size, source, source_size, target, taken``: ``taken`` is a whole multiple of ``size``, but for
    the one document of a source (or those with its hash) at which the budget ends. No document is taken more
    than ``ceil(cap)`` times, and each source's taken words are its target, rounded down.

    * null source: a source of its own, last in order; null text and text without words: size 0, taken 0;
    * null id: hashed as such; repeated rows share their hash, and so are taken alike, in proportion at the threshold;
    * empty table: no rows; other columns are not read. Reruns and other partitionings give the same: the hash is md5 of the id.
    """
    sized = materialize(docs.select(*_named(docs, id_col, text_col, source_col)), "sized")
    limits, small = mix_thresholds(sized, budget_share, cap, weights or [5, 2, 1])
    return _with_taken(sized, limits, small).select("doc_id", "size", "source", "source_size", "target", "taken")


def draw_mix(docs: DataFrame, budget_share: float = 1.5, cap: float = 2.0, weights: list[int] | None = None, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as the mix takes it, with all of its columns.

    Rows are whole: the document at which a source's budget ends is taken once more if that is nearer to the
    target. Texts are scanned twice and never shuffled while there are few sources. Documents that the mix
    doesn't take, those without words among them, are left out.
    """
    sized = materialize(docs.select(*_named(docs, id_col, text_col, source_col)).drop("doc_id"), "sized")
    limits, small = mix_thresholds(sized, budget_share, cap, weights or [5, 2, 1])
    rows = docs.select(F.struct("*").alias("_row"), *_named(docs, id_col, text_col, source_col)[1:])
    times = F.round(F.try_divide("taken", "size")).cast("int")
    return _with_taken(rows, limits, small).where(times >= 1).select("_row", F.explode(F.sequence(F.lit(1), times)).alias("_copy")).select("_row.*")
