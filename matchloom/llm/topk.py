"""Exact top-k inner-product search: a ball tree a shard, searched by branch and bound.

Vectors are dealt out to shards by a hash, queries to blocks, and a task gets one shard and one
block: both of bounded size. A task builds the shard's ball tree once for all queries of a large block, and walks it for each, best bound
first. A block holds twice a shard's rows, so building is a small part of searching, and a shard is copied once for each
block and not for each query. A node's bound is <q, centre> + |q| * radius; a node whose bound is under the query's current k-th
score is cut, with all below it.

The current k-th scores are shared twice. Inside a shard each leaf raises the query's own floor. Across
shards a first round searches one home shard for every block; its k-th scores then go along with the queries as
floors into all other shards, which cut from the start.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 16_384, 32_768, 128
#: Vectors longer than 64 components come in smaller shards and blocks: at most so many numbers a shard.
SHARD_CELLS = SHARD_ROWS * 64
_EXACT = float(1 << 53)


class BallTree:
    """Nodes in arrays: centre, radius, and either two children or a range of rows."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        n = len(vectors)
        self.order = np.arange(n)
        centres, radii, kids, spans = [], [], [], []
        stack = [(0, n, -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            at = len(centres)
            if parent >= 0:
                kids[parent][side] = at
            own = vectors[self.order[lo:hi]]
            centre = own.mean(axis=0)
            far = np.sqrt(((own - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(far.max() if hi > lo else 0.0)
            kids.append([-1, -1])
            spans.append((lo, hi))
            if hi - lo > leaf_rows:
                a = own[far.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                # Halves of equal size along the two farthest rows: equal vectors are cut in two as well.
                self.order[lo:hi] = self.order[lo:hi][np.argsort(own @ (b - a), kind="stable")]
                mid = (lo + hi) // 2
                stack += [(lo, mid, at, 0), (mid, hi, at, 1)]
        self.centres, self.radii, self.kids, self.spans = np.array(centres).reshape(len(centres), vectors.shape[1]), np.array(radii), kids, spans


def search_shard(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, floors: list[float], k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query its up to ``k`` best (score, id) here that reach its floor (none: -inf); ties go to the smaller id.

    A row of the query's own id is no candidate; any other row is one, repeated ids too.
    """
    norms = np.sqrt((queries**2).sum(axis=1))
    exact = (np.sqrt((vectors**2).sum(axis=1)).max(initial=0.0) + 1) * (norms.max(initial=0.0) + 1) < _EXACT
    tree = BallTree(vectors)
    ids, vectors = ids[tree.order], vectors[tree.order]
    if not exact:  # beyond the integers that doubles hold: the same search with Python's integers
        whole = [[int(x) for x in v] for v in vectors]
    far = np.sqrt((tree.centres**2).sum(axis=1))
    for first in range(0, len(queries), 1024):  # the bounds of some queries at a time
        part = queries[first : first + 1024]
        own_norms = norms[first : first + 1024, None]
        bounds = part @ tree.centres.T + own_norms * tree.radii[None, :]
        # A little above the true bound, so that rounding cuts nothing.
        bounds += 1e-9 * (np.abs(bounds) + own_norms * (1 + far)[None, :]) + 1e-6
        for i, q in enumerate(part, start=first):
            best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
            floor, bound = floors[i], bounds[i - first]
            cut = np.nextafter(float(floor), -np.inf)  # as a double a floor may lie above itself
            heap = [(-bound[0], 0)]
            while heap:
                b, node = heapq.heappop(heap)
                if -b < cut:
                    break
                left, right = tree.kids[node]
                if left >= 0:
                    for kid in (left, right):
                        if bound[kid] >= cut:
                            heapq.heappush(heap, (-bound[kid], kid))
                    continue
                lo, hi = tree.spans[node]
                if exact:
                    scores = vectors[lo:hi] @ q
                    near = np.flatnonzero(scores >= cut)
                    got = zip(scores[near].tolist(), ids[lo:hi][near].tolist(), strict=True)
                else:
                    own = [int(x) for x in q]
                    got = ((min(max(sum(a * b for a, b in zip(v, own, strict=True)), -(1 << 63)), (1 << 63) - 1), d) for v, d in zip(whole[lo:hi], ids[lo:hi].tolist(), strict=True))
                for score, doc in got:
                    if doc != q_ids[i]:
                        item = (int(score), -doc)
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                if len(best) == k and best[0][0] > floor:
                    floor = best[0][0]
                    cut = np.nextafter(float(floor), -np.inf)
            yield i, sorted(((s, -d) for s, d in best if s >= floors[i]), key=lambda x: (-x[0], x[1]))


def _matrix(batch: pa.Table, name: str, rows: np.ndarray) -> np.ndarray:
    col = batch.column(name).take(pa.array(rows)).combine_chunks()
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def _task(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        is_query = np.asarray(group.column("is_query").combine_chunks(), dtype=bool)
        ids = np.asarray(group.column("vec_id"), dtype=np.int64)
        at_q, at_v = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(at_q) or not len(at_v):
            return schema.empty_table()
        floors = [-float("inf") if f is None else f for f in group.column("floor").take(pa.array(at_q)).to_pylist()]
        out = [(ids[at_q[i]], doc, score) for i, found in search_shard(ids[at_v], _matrix(group, "v", at_v), ids[at_q], _matrix(group, "v", at_q), floors, k) for score, doc in found]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "v",
               shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product for each of ``queries``, its own id left out.

    Both tables hold an id and an array of whole-numbered doubles. Returns ``query_id, rank, vec_id, score``.

    * null ids, null vectors and vectors with null or non-finite components take no part;
    * only vectors of a query's own length are its candidates; empty vectors score 0 with each other;
    * repeated rows are candidates each, and none for a query of their id; a repeated query asks once, with its smallest vector;
    * equal vectors tie, and the smaller id wins;
    * fewer than ``k`` candidates: all of them; empty tables: no rows; other columns are not read;
    * a score beyond 64 bits counts as the nearest 64-bit integer.
    """
    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(whole) \
            .withColumn("dim", F.size("v"))

    rows = materialize(clean(vectors), "vectors")
    asked = materialize(clean(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    size = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    share = min(1.0, SHARD_CELLS / (SHARD_ROWS * max(1, size["dim"] or 1)))
    shards = max(1, math.ceil(size["n"] / max(1, shard_rows * share)))
    blocks = max(1, math.ceil(asked.count() / max(1, block_rows * share)))
    # By id and vector: the rows of a repeated id are spread.
    rows = rows.withColumn("shard", F.expr(f"cast(pmod(xxhash64(vec_id, v), {shards}) as int)"))
    asked = asked.withColumn("block", F.expr(f"cast(pmod(xxhash64(vec_id, 7), {blocks}) as int)"))
    home = F.expr(f"pmod(block, {shards})")

    def searched(asked_in: DataFrame, rows_in: DataFrame) -> DataFrame:
        """``asked_in`` has shard, block, floor; ``rows_in`` has shard, block: one task for each (dim, shard, block)."""
        both = asked_in.select("dim", "shard", "block", F.lit(True).alias("is_query"), "vec_id", "v", "floor") \
            .unionByName(rows_in.select("dim", "shard", "block", F.lit(False).alias("is_query"), "vec_id", "v", F.lit(None).cast("long").alias("floor")))
        return both.groupBy("dim", "shard", "block").applyInArrow(_task(k), "query_id long, vec_id long, score long")

    at_home = searched(asked.withColumn("shard", home).withColumn("floor", F.lit(None).cast("long")),
                       rows.withColumn("block", F.explode(F.expr(f"filter(sequence(0, {blocks - 1}), b -> pmod(b, {shards}) = shard)"))))
    first = materialize(at_home, "home")
    if shards == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", "score")
    # The k-th score at home, if there are k, is the floor everywhere else.
    floors = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    away = asked.join(floors, "vec_id", "left")
    away = away.withColumn("shard", F.explode(F.expr(f"filter(sequence(0, {shards - 1}), s -> s <> pmod(block, {shards}))")))
    others = rows.withColumn("block", F.explode(F.expr(f"filter(sequence(0, {blocks - 1}), b -> pmod(b, {shards}) <> shard)")))
    return _best(first.unionByName(searched(away, others)), k).select("query_id", "rank", "vec_id", "score")
