"""Ranking pools (one positive, some negatives) and rank metrics.

A pool row is ``query, pos, cand``: position 0 is the query's own candidate. Pools grow with the number of queries, never with queries
times candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.lexical import first_by
from matchloom.operators.running import digest, shuffled_index

NEGATIVES = 19


def own_rows(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.lit(0).alias("pos"), F.col("query").alias("cand"))


def random_pools(records: DataFrame, row_id: str, label: str, seed: int, negatives: int = NEGATIVES) -> DataFrame:
    """For each positive ``negatives`` rows of the other class, without repeats; of all other rows if that class has too few.

    Candidates lie in a hashed order, and a query takes those that follow a place of its own, round and round.
    """
    queries = records.where(F.col(label) == 1).select(F.col(row_id).alias("query"))
    others = records.where(F.col(label) != 1)
    n = others.count()
    everyone = n < negatives
    source = records if everyone else others
    n = records.count() if everyone else n
    k = min(negatives, n - 1 if everyone else n)
    if k <= 0:
        return own_rows(queries)
    order = shuffled_index(source.select(F.col(row_id).alias("cand"), digest(F.lit(seed), F.col(row_id)).alias("h")), [], "h", "cand").select("cand", F.col("pos").alias("place"))
    if everyone:  # a query's own place starts its round
        start = queries.join(order, F.col("query") == F.col("cand")).select("query", (F.col("place") + 1).alias("start"))
    else:
        start = queries.withColumn("start", F.conv(F.substring(digest(F.lit("start"), F.lit(seed), F.col("query")), 1, 8), 16, 10).cast("long"))
    drawn = start.select("query", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("start") + i) % n)).alias("i", "place"))
    return own_rows(queries).unionByName(drawn.join(order, "place").select("query", (F.col("i") + 1).alias("pos"), "cand"))


def hard_pools(queries: DataFrame, scored: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """For each query the ``negatives`` candidates with the largest ``similarity``, ties to the smaller id.

    ``scored``: ``query, cand, similarity`` of candidates that aren't the query's own.
    """
    best = first_by(scored.where(F.col("query") != F.col("cand")), ["query"], [F.isnan("similarity"), F.desc("similarity"), F.col("cand")], negatives, "pos")
    return own_rows(queries).unionByName(best.select("query", "pos", "cand"))


def rank_of_own(pool: DataFrame, keys: list[str], score: str = "score", ties: str = "optimistic") -> DataFrame:
    """``keys, rank`` of position 0 in the order of falling scores. Equal scores rank by position, so the own one wins ties;
    with ``ties='pessimistic'`` it loses them. Nulls and NaN come last.
    """
    s = F.when(F.isnan(score), None).otherwise(F.col(score))
    own = F.max(F.when(F.col("pos") == 0, s)).over(Window.partitionBy(*keys))
    above = F.when(F.col("pos") == 0, 0).when(own.isNull(), F.when(s.isNotNull(), 1).otherwise(0 if ties == "optimistic" else 1)) \
        .when((s > own) if ties == "optimistic" else (s >= own), 1).otherwise(0)
    return pool.withColumn("_above", above).groupBy(*keys).agg((F.sum("_above") + 1).cast("int").alias("rank"))


def top_of_pool(pool: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """``keys, top``: the candidate with the largest score, ties to the smaller position; nulls and NaN come last."""
    s = F.when(~F.isnan(score), F.col(score))
    return pool.groupBy(*keys).agg(F.max(F.struct(s.isNotNull().alias("_h"), s.alias("_s"), (-F.col("pos")).alias("_p"), "cand"))["cand"].alias("top"))


def rank_metrics(rank: Column, k: int = 5) -> dict[str, Column]:
    """With one relevant row a query: recall, NDCG at k, reciprocal rank, hit at 1."""
    return {f"recall_at_{k}": (rank <= k).cast("double"), f"ndcg_at_{k}": F.when(rank <= k, 1 / F.log2(rank + 1.0)).otherwise(0.0), "mrr": 1.0 / rank, "hit_at_1": (rank == 1).cast("double")}


def mean_rank_metrics(ranks: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    return ranks.groupBy(*keys).agg(*(F.avg(c).alias(n) for n, c in rank_metrics(F.col("rank"), k).items()), F.count("*").alias("queries"))
