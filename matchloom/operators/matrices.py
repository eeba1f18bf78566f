"""Score matrices in long form: a row for each query and candidate.

They are quadratic by contract. Whole matrices are made from blocks: ``knowledge_matrix`` and ``embedding.all_cosines`` move neither texts nor
vectors for each pair. Where pairs are given, ids alone are paired, and vectors and token sets join the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.functions import vectors as V
from matchloom.operators.postings import Postings, hashed, jaccard, lists, pieces, ratio, summed

BLOCK = 1024


def all_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``query, cand`` of all ids: each query meets every block of candidates."""
    n = max(1, -(-candidates.count() // BLOCK))
    left = queries.select("query", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_b"))
    right = candidates.select("cand", F.expr(f"cast(pmod(xxhash64(cand), {n}) as int)").alias("_b"))
    return left.join(right, "_b").select("query", "cand")


def noisy_vectors(vectors: DataFrame, epsilon: float, seed: int = 3407, clip: float = 1.0, second_clip: float = 2.0) -> DataFrame:
    """``idx, rv, jv``, clipped, with noise of a budget, clipped again and not brought to unit length. Noise hangs on ids and seeds, ``seed`` and the next."""
    sigma = F.lit(V.gaussian_sigma(epsilon, sensitivity=clip))
    noisy = lambda c, s, side: V.private_vector(F.col(c), V.keyed_noise(F.size(c), F.lit(s), F.lit(side), F.col("idx")), sigma, clip, normalize=False)
    drawn = vectors.select("idx", noisy("rv", seed, "resume").alias("rv"), noisy("jv", seed + 1, "job").alias("jv"))
    again = lambda c: V.scaled(F.col(c), V.clip_scale(V.norm(F.col(c)), second_clip)).alias(c)
    return drawn.select("idx", again("rv"), again("jv"))


def vector_scores(vectors: DataFrame, pairs: DataFrame, out: str) -> DataFrame:
    """``query, cand`` and the cosine of the query's ``rv`` and the candidate's ``jv``."""
    unit = lambda key, c: vectors.select(F.col("idx").alias(key), V.l2_normalize(F.col(c)).alias(c))
    met = pairs.join(unit("query", "rv"), "query").join(unit("cand", "jv"), "cand")
    return met.select("query", "cand", V.dot(F.col("rv"), F.col("jv")).alias(out))


def _job_parts(records: DataFrame) -> dict[str, Column]:
    """Token sets of a job: ``job``, ``needs``, ``extra`` and ``criteria``."""
    has = set(records.columns)
    needs = F.col("minimum_requirements") if "minimum_requirements" in has else F.array("requirement_text") if "requirement_text" in has else F.array().cast("array<string>")
    info = F.col("additional_info") if "additional_info" in has else F.lit("")
    maps = [F.col(c) for c in ("macro_dict", "micro_dict") if c in has] or [F.create_map().cast("map<string,double>")]
    return {"job": T.token_set(F.col("job_text")), "needs": T.item_sets(needs), "extra": T.token_set(info), "criteria": T.criteria_sets(T.entries_of(*maps))}


def knowledge_scores(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``query, cand, overall, consistency``: a query's resume against the candidate's job, requirements, additional information and criteria.

    ``records`` has ``idx, resume_text, job_text`` and may have ``requirement_text`` or ``minimum_requirements``, ``additional_info`` and the maps
    ``macro_dict`` and ``micro_dict``; what it lacks is empty.
    """
    resumes = records.select(F.col("idx").alias("query"), T.token_set(F.col("resume_text")).alias("own"))
    jobs = records.select(F.col("idx").alias("cand"), *(c.alias(n) for n, c in _job_parts(records).items()))
    parts = T.knowledge_components(F.col("own"), F.col("job"), F.col("needs"), F.col("extra"), F.col("criteria"))
    met = pairs.join(resumes, "query").join(jobs, "cand").select("query", "cand", *(c.alias(n) for n, c in parts.items()))
    named = {n: F.col(n) for n in parts}
    return met.select("query", "cand", T.weighted(named, T.OVERALL_WEIGHTS).alias("overall"), T.weighted(named, T.CONSISTENCY_WEIGHTS).alias("consistency"))


def knowledge_matrix(resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """``knowledge_scores`` of all pairs of ``resumes`` (``idx, resume_text``) and ``jobs`` (``idx, job_text`` and what ``records`` may have there).

    Workers hold the jobs' token sets, and resumes are read once, where they lie: nothing is shuffled.
    """
    parts = _job_parts(jobs)
    criteria = F.transform(parts.pop("criteria"), lambda c: F.struct(hashed(c["keys"]).alias("keys"), c["weight"].alias("weight")))
    needs = F.transform(parts.pop("needs"), hashed)
    held = jobs.select(F.col("idx").alias("cand"), *(hashed(c).alias(n) for n, c in parts.items()), needs.alias("needs"), criteria.alias("criteria")).collect()
    n, ids = len(held), np.array([r["cand"] for r in held])
    whole, rest = [r["job"] for r in held], [r["extra"] for r in held]
    need = [(i, s) for i, r in enumerate(held) for s in r["needs"]]
    # What a job says of its criteria itself is there for every resume.
    wish = [(i, c["weight"], len(c["keys"]), set(c["keys"]) - set(r["job"])) for i, r in enumerate(held) for c in r["criteria"]]
    slots = Postings.of_sets([*whole, *rest, *(s for _, s in need), *(s for *_, s in wish)])
    job_size, extra_size, need_size = (np.array([len(s) for s in x], dtype=float) for x in (whole, rest, [s for _, s in need]))
    need_of, wish_of = (np.array([x[0] for x in y], dtype=np.int64) for y in (need, wish))
    needs_of = np.bincount(need_of, minlength=n).astype(float)
    weight, key_size = (np.array([x[k] for x in wish], dtype=float) for k in (1, 2))
    given = key_size - np.array([len(x[3]) for x in wish], dtype=float)
    weights_of = summed(weight[None, :], wish_of, n)[0]
    cut = np.cumsum([n, n, len(need)])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, slots.n):
                tokens, ends = lists(piece, "own")
                job_hits, extra_hits, need_hits, wish_hits = np.split(slots.sums(tokens, ends), cut, axis=1)
                size, found = np.diff(ends).astype(float), wish_hits + given
                gained = np.where((found > 0) & (found == key_size), weight, np.where(found > 0, 0.5 * weight, 0.0))
                named = {"jaccard": jaccard(job_hits, size, job_size), "requirement": ratio(summed(need_hits / need_size, need_of, n), needs_of[None, :]),
                         "additional": jaccard(extra_hits, size, extra_size), "criteria": np.where(weights_of > 0, ratio(summed(gained, wish_of, n), weights_of[None, :]), 0.0)}
                out = [sum((w * named[k] for k, w in ws.items()), np.zeros((len(size), n))) for ws in (T.OVERALL_WEIGHTS, T.CONSISTENCY_WEIGHTS)]
                query = np.repeat(piece.column("query").to_numpy(zero_copy_only=False), n)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.tile(ids, len(size))), *(pa.array(x.ravel()) for x in out)], names=["query", "cand", "overall", "consistency"])

    kinds = dict(resumes.dtypes)["idx"], dict(jobs.dtypes)["idx"]
    own = resumes.select(F.col("idx").alias("query"), F.array_distinct(hashed(T.tokenize(F.col("resume_text")))).alias("own"))
    if not n:
        return own.selectExpr("query", f"cast(null as {kinds[1]}) as cand", "0D as overall", "0D as consistency").where("false")
    return own.mapInArrow(scores, f"query {kinds[0]}, cand {kinds[1]}, overall double, consistency double")


def ranks_in_matrix(long: DataFrame, keys: list[str], own: str = "query") -> DataFrame:
    """``keys, rank, top``: the own candidate's rank in its row (ties to the smaller id), and the row's first candidate.

    ``long`` is ``keys, query, cand, score``; ``own`` is the column with the own candidate's id. Counts and largest values, nothing is sorted.
    """
    held = long.where(F.col(own) == F.col("cand")).select(*keys, F.col("score").alias("_own"))
    ahead = (F.col("score") > F.col("_own")) | ((F.col("score") == F.col("_own")) & (F.col("cand") < F.col(own)))
    first = F.max(F.struct("score", (-F.col("cand")).alias("c")))["c"]
    return long.join(held, keys).groupBy(*keys).agg((F.count_if(ahead) + 1).cast("int").alias("rank"), (-first).alias("top"))
