"""Queries on vectors and private scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import vectors as V
from matchloom.operators import matrices, metrics
from matchloom.operators.embedding import all_cosines, nearest
from matchloom.operators.storage import stored
from matchloom.plans.base import query, rounded, table

EPSILONS = [0.5, 1.0, 2.0, 4.0, 8.0]
SEEDS = [3407, 42, 2026]
_SIGMA = "sqrt(2 * ln(1.25::DOUBLE / 0.00001)) / {e}"
_E = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM e)"""
#: Each vector with its mate, the one after the next in a ring of ids.
_M = f"""{_E},
m AS (SELECT a.vec_id, b.vec_id AS mate, a.v AS va, b.v AS vb, a.len AS la, b.len AS lb FROM (SELECT *, (vec_id + 2) % (SELECT count(*) FROM embeddings) AS next FROM n) a JOIN n b ON b.vec_id = a.next)"""


def _z(seed: str, side: str, i: str, dim: str) -> str:
    h = f"md5(concat_ws('|', {seed}, '{side}', {i}, {dim}))"
    return f"sqrt(-2 * ln((('0x' || substr({h}, 1, 8))::UBIGINT::DOUBLE + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * (('0x' || substr({h}, 9, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE))"


_NOISY = f"""{_M},
seeds AS (SELECT * FROM (VALUES (3407), (42), (2026)) s(seed)),
z AS (SELECT seed, vec_id, mate, la, lb, list_transform(va, lambda x: x / CASE WHEN la > 1 THEN la ELSE 1 END) AS ca, list_transform(vb, lambda x: x / CASE WHEN lb > 1 THEN lb ELSE 1 END) AS cb,
  list_transform(range(len(va)), lambda i: {_z('seed', 'l', 'vec_id', 'i')}) AS za, list_transform(range(len(vb)), lambda i: {_z('seed + 1', 'r', 'mate', 'i')}) AS zb FROM m, seeds),
p AS (SELECT *, list_dot_product(ca, cb) AS cc, list_dot_product(ca, zb) + list_dot_product(za, cb) AS cz, list_dot_product(za, zb) AS zz, list_dot_product(ca, ca) AS aa, 2 * list_dot_product(ca, za) AS az, list_dot_product(za, za) AS azz,
  list_dot_product(cb, cb) AS bb, 2 * list_dot_product(cb, zb) AS bz, list_dot_product(zb, zb) AS bzz FROM z)"""


def _cos(s: str) -> str:
    den = f"(sqrt(aa + {s} * az + {s} * {s} * azz) * sqrt(bb + {s} * bz + {s} * {s} * bzz))"
    return f"(cc + {s} * cz + {s} * {s} * zz) / CASE WHEN {den} = 0 THEN 1 ELSE {den} END"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, mate, va, vb``: each vector with its mate, two further in a ring of ids."""
    e = embeddings(spark, sf_dir)
    n = e.count()
    return e.select("vec_id", F.pmod(F.col("vec_id") + 2, F.lit(n)).alias("mate"), F.col("v").alias("va")).join(e.select(F.col("vec_id").alias("mate"), F.col("v").alias("vb")), "mate")


def noisy_products(spark: SparkSession, sf_dir: str, clip: float = 1.0, seeds: list[int] | None = None) -> DataFrame:
    """Inner products of clipped mates and their noise, a row a seed.

    With noise of size s a side is c + s * z, so every private cosine is a fraction of polynomials in s: one pass over the vectors
    serves all budgets, and noise is drawn once for a seed.
    """
    m = mates(spark, sf_dir).withColumn("seed", F.explode(F.array(*map(F.lit, seeds or SEEDS))))
    clipped = lambda v: V.scaled(F.col(v), V.clip_scale(V.norm(F.col(v)), clip))
    z = m.select("seed", "vec_id", "mate", clipped("va").alias("ca"), clipped("vb").alias("cb"), V.keyed_noise(F.size("va"), F.col("seed"), F.lit("l"), F.col("vec_id")).alias("za"),
                 V.keyed_noise(F.size("vb"), F.col("seed") + 1, F.lit("r"), F.col("mate")).alias("zb"))
    d = lambda a, b: V.dot(F.col(a), F.col(b))
    return z.select("seed", "vec_id", "mate", d("ca", "cb").alias("cc"), (d("ca", "zb") + d("za", "cb")).alias("cz"), d("za", "zb").alias("zz"), d("ca", "ca").alias("aa"), (2 * d("ca", "za")).alias("az"), d("za", "za").alias("azz"),
                    d("cb", "cb").alias("bb"), (2 * d("cb", "zb")).alias("bz"), d("zb", "zb").alias("bzz"))


def private_cosine(sigma: Column) -> Column:
    s, c = sigma, F.col
    return V.cosine_of(c("cc") + s * c("cz") + s * s * c("zz"), F.sqrt(c("aa") + s * c("az") + s * s * c("azz")), F.sqrt(c("bb") + s * c("bz") + s * s * c("bzz")))


@query(f"WITH {_E} SELECT vec_id, round(len, 6) AS norm, list_transform(v, lambda x: round(x / CASE WHEN len = 0 THEN 1 ELSE len END, 6)) AS unit FROM n")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", rounded(V.norm(F.col("v"))).alias("norm"), F.transform(V.l2_normalize(F.col("v")), lambda x: rounded(x)).alias("unit"))


@query(f"WITH {_E} SELECT vec_id, round(least(len, 0.9::DOUBLE), 6) AS clipped_norm, len > 0.9 AS was_clipped FROM n")
def clip_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumn("len", V.norm(F.col("v")))
    c = e.select("vec_id", "len", V.scaled(F.col("v"), V.clip_scale(F.col("len"), 0.9)).alias("c"))
    return c.select("vec_id", rounded(V.norm(F.col("c"))).alias("clipped_norm"), (F.col("len") > 0.9).alias("was_clipped"))


@query(f"SELECT epsilon, round({_SIGMA.format(e='epsilon')}, 6) AS sigma FROM (VALUES (0.5::DOUBLE), (1.0), (2.0), (4.0), (8.0)) t(epsilon)")
def sigma_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e,) for e in EPSILONS], "epsilon double").select("epsilon", rounded(V.sigma_column(F.col("epsilon"))).alias("sigma"))


@query(f"WITH {_M} SELECT vec_id, mate, round(list_dot_product(va, vb) / CASE WHEN la * lb = 0 THEN 1 ELSE la * lb END, 6) AS cosine FROM m")
def cosine_own_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mates(spark, sf_dir).select("vec_id", "mate", rounded(V.cosine(F.col("va"), F.col("vb"))).alias("cosine"))


@query(f"WITH {_NOISY} SELECT seed, vec_id, mate, round({_cos('(' + _SIGMA.format(e='2.0::DOUBLE') + ')')}, 6) AS dp_cosine FROM p")
def dp_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private cosine at a budget of 2, a row a seed."""
    return noisy_products(spark, sf_dir).select("seed", "vec_id", "mate", rounded(private_cosine(F.lit(V.gaussian_sigma(2.0)))).alias("dp_cosine"))


@query(f"""WITH {_NOISY}, s AS (SELECT epsilon, seed, {_cos('(' + _SIGMA.format(e='epsilon') + ')')} AS x FROM p, (VALUES (0.5::DOUBLE), (1.0), (2.0), (4.0), (8.0)) t(epsilon))
SELECT epsilon, seed, count(*) AS pairs, round(avg(x), 6) AS cosine_mean, round(stddev_pop(x), 6) AS cosine_std FROM s GROUP BY ALL""")
def dp_epsilon_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five budgets and three seeds in one job."""
    s = noisy_products(spark, sf_dir).withColumn("epsilon", F.explode(F.array(*map(F.lit, EPSILONS))))
    x = s.select("epsilon", "seed", private_cosine(V.sigma_column(F.col("epsilon"))).alias("x"))
    return x.groupBy("epsilon", "seed").agg(F.count("*").alias("pairs"), rounded(F.avg("x")).alias("cosine_mean"), rounded(F.stddev_pop("x")).alias("cosine_std"))


@query(f"""WITH {_E}, u AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN len = 0 THEN 1 ELSE len END) AS u FROM n),
s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.u, b.u), 9) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT id, CAST(rank AS INTEGER) AS rank, other, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every vector."""
    e = embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "v")
    return nearest(e, e, 5).withColumn("cosine", rounded(F.col("cosine")))


_TOXIC = "x AS (SELECT doc_id, toxic, doc_id % (SELECT count(*) FROM embeddings) AS vec_id FROM labels)"


@query(f"""WITH {_NOISY}, {_TOXIC}, s AS (SELECT epsilon, seed, toxic, round({_cos('(' + _SIGMA.format(e='epsilon') + ')')}, 9) AS score FROM p JOIN x USING (vec_id), (VALUES (0.5::DOUBLE), (1.0), (2.0), (4.0), (8.0)) t(epsilon)),
g AS (SELECT epsilon, seed, score, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic <> 1) AS neg FROM s GROUP BY ALL),
b AS (SELECT *, sum(neg) OVER (PARTITION BY epsilon, seed ORDER BY score) - neg AS before FROM g),
a AS (SELECT epsilon, seed, sum(pos * (before + neg / 2.0))::DOUBLE / (sum(pos) * sum(neg)) AS auc FROM b GROUP BY epsilon, seed)
SELECT epsilon, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std, count(*) AS runs, round({_SIGMA.format(e='epsilon')}, 6) AS sigma FROM a GROUP BY epsilon""")
def dp_auc_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the private cosine at each budget, mean and deviation over seeds; a labelled document has the vector of its number."""
    n = table(spark, sf_dir, "embeddings").count()
    labels = table(spark, sf_dir, "labels").select(F.pmod("doc_id", F.lit(n)).alias("vec_id"), F.col("toxic").alias("label"))
    products = stored(noisy_products(spark, sf_dir), "noisy_products")
    swept = products.join(labels, "vec_id").withColumn("epsilon", F.explode(F.array(*map(F.lit, EPSILONS))))
    scores = swept.select("epsilon", "seed", "label", F.round(private_cosine(V.sigma_column(F.col("epsilon"))), 9).alias("score"))
    found = metrics.mean_std(metrics.roc_auc(scores, ["epsilon", "seed"]), ["epsilon"], ["auc"])
    return found.select("epsilon", rounded(F.col("auc_mean")).alias("auc_mean"), rounded(F.col("auc_std")).alias("auc_std"), "runs", rounded(V.sigma_column(F.col("epsilon"))).alias("sigma"))


def _side(name: str, seed: int, label: int, side: str) -> str:
    clipped = "CASE WHEN len > 1 THEN len ELSE 1 END"
    return f"""{name} AS (SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: v[i] / {clipped} + {_SIGMA.format(e='2.0::DOUBLE')} * ({_z(str(seed), side, 'vec_id', 'i - 1')})) AS w FROM n JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) WHERE label = {label}),
{name}c AS (SELECT vec_id, list_transform(w, lambda x: x * CASE WHEN sqrt(list_dot_product(w, w)) > 2 THEN 2 / sqrt(list_dot_product(w, w)) ELSE 1 END) AS w FROM {name})"""


@query(f"""WITH {_E}, {_side('lq', 3407, 1, 'resume')}, {_side('rc', 3408, 0, 'job')}
SELECT q.vec_id AS query, c.vec_id AS cand, round(list_dot_product(q.w, c.w) / (sqrt(list_dot_product(q.w, q.w)) * sqrt(list_dot_product(c.w, c.w))), 6) AS score FROM lqc q, rcc c""")
def noisy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors of class 1 and class 0 under noise at a budget of 2, clipped before it at 1 and after it at 2."""
    e = embeddings(spark, sf_dir)
    noisy = matrices.noisy_vectors(e.where("label in (0, 1)").select(F.col("vec_id").alias("idx"), F.col("v").alias("rv"), F.col("v").alias("jv")), 2.0)
    side = lambda label, c: held.where(F.col("label") == label).select(F.col("idx").alias("id"), F.col(c).alias("v"))
    held = stored(noisy.join(e.select(F.col("vec_id").alias("idx"), "label"), "idx"), "noisy")
    return all_cosines(side(1, "rv"), side(0, "jv"), "score")
