"""Full retrieval by several methods: each query's text against all candidates, judged without a row for each pair.

Workers hold the candidates' postings. Scores of a query are made twice, once for the ends that fusion scales by and once for ranks: they
are cheaper to make than to store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.postings import Postings, jaccard, lists, pieces, ratio

METHODS = ["bm25", "kg", "jaccard", "retrieval_fusion"]


def _grid(sets: DataFrame, postings: DataFrame):
    """Candidates' ids, ascending, and a function from pieces of queries to each method's rows x candidates."""
    held = sorted(sets.collect(), key=lambda r: r["cand"])
    ids = np.array([r["cand"] for r in held], dtype=np.int64)
    hits, sizes = Postings.of_sets([r["b"] for r in held]), np.array([len(r["b"]) for r in held], dtype=float)
    found = postings.select("cand", "term", "weight").toPandas()
    weighed = Postings(found["term"].to_numpy(dtype=np.int64), np.searchsorted(ids, found["cand"].to_numpy(dtype=np.int64)), len(ids), found["weight"].to_numpy(dtype=float))

    def scores(piece: pa.RecordBatch) -> dict[str, np.ndarray]:
        tokens, ends = lists(piece, "tokens")
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        order = np.lexsort((tokens, row))
        t, r = tokens[order], row[order]
        first = np.ones(len(t), dtype=bool)
        first[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
        size = np.bincount(r[first], minlength=len(ends) - 1)
        both = hits.sums(t[first], np.concatenate([[0], np.cumsum(size)]))
        return {"bm25": weighed.sums(tokens, ends), "kg": ratio(both, sizes[None, :]), "jaccard": jaccard(both, size.astype(float), sizes)}

    return ids, scores


def judged(queries: DataFrame, sets: DataFrame, postings: DataFrame, weights: dict[str, float], k: int = 5) -> DataFrame:
    """A row for each of ``METHODS``: rank metrics of queries of ``quality`` 1, the mean Jaccard score of every query's first candidate
    (``consistency``), and ``score_mean`` and ``score_std`` of all scores (9 places). Ties go to the smaller candidate.

    ``queries`` (stored) is ``query, quality, own, tokens``, ``sets`` is ``cand, b`` and ``postings`` is ``cand, term, weight``; tokens are hashes.
    ``weights`` are those of the fusion, whose parts are scaled to [0, 1] over the whole matrix.
    """
    ids, scores = _grid(sets, postings)
    names = list(weights)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, seen = np.full(len(names), np.inf), np.full(len(names), -np.inf), False
        for batch in batches:
            for piece in pieces(batch, len(ids)):
                found, seen = scores(piece), True
                lo = np.minimum(lo, [found[m].min() for m in names])
                hi = np.maximum(hi, [found[m].max() for m in names])
        if seen:
            yield pa.RecordBatch.from_pydict({"at": list(range(len(names))), "lo": lo, "hi": hi}, schema=pa.schema([("at", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))

    ends = {r["at"]: (r["lo"], r["hi"]) for r in queries.mapInArrow(spans, "at int, lo double, hi double").groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}

    def scaled(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
        return np.zeros(x.shape) if abs(hi - lo) <= 1e-8 + 1e-5 * abs(hi) else (x - lo) / (hi - lo)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, len(ids)):
                found = scores(piece)
                found["retrieval_fusion"] = sum(w * scaled(found[m], *ends[i]) for i, (m, w) in enumerate(weights.items()))
                rows = np.arange(piece.num_rows)
                own = piece.column("own").to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                known = ids[at] == own
                for name in METHODS:
                    x = np.round(found[name], 9)
                    mine = x[rows, at][:, None]
                    ahead = ((x > mine) | ((x == mine) & (np.arange(len(ids))[None, :] < at[:, None]))).sum(axis=1)
                    # The first of the largest: candidates ascend.
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), piece.column("query"), piece.column("quality"), pa.array((ahead + 1).astype(np.int32), mask=~known),
                                                      pa.array(found["jaccard"][rows, x.argmax(axis=1)]), pa.array(x.mean(axis=1)), pa.array(x.var(axis=1))],
                                                     names=["method", "query", "quality", "rank", "top_jaccard", "mean", "var"])

    kinds = dict(queries.dtypes)
    rows = queries.mapInArrow(ranks, f"method string, query {kinds['query']}, quality {kinds['quality']}, rank int, top_jaccard double, mean double, var double")
    good = (F.col("quality") == 1) & F.col("rank").isNotNull()
    cut = rows.withColumn("rank", F.when(good, F.col("rank")))
    rank = F.col("rank")
    # Every query has as many candidates, so variance is the mean of variances and the variance of means. Means leave nulls out.
    found = cut.groupBy("method").agg(
        F.avg(F.when(rank.isNotNull(), (rank <= k).cast("double"))).alias(f"recall_at_{k}"), F.avg(F.when(rank <= k, 1 / F.log2(rank + 1.0)).when(rank.isNotNull(), 0.0)).alias(f"ndcg_at_{k}"),
        F.avg(1.0 / rank).alias("mrr"), F.avg((rank == 1).cast("double")).alias("hit_at_1"), F.count("rank").alias("queries"), F.avg("top_jaccard").alias("consistency"),
        F.avg("mean").alias("score_mean"), F.sqrt(F.avg("var") + F.var_pop("mean")).alias("score_std"))
    return found.where("queries > 0")
