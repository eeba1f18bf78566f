"""Composite experiments on records ``idx, resume_text, job_text, requirement_text, raw_score`` (``idx`` long and unique).

Budgets, seeds, folds and thresholds are columns. Only the training of models loops on the driver, a few at a time; each loop step is a Spark job over all rows.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.functions import vectors as V
from matchloom.operators import fusion, learn, lexical, matrices, metrics, pools, splits
from matchloom.operators.embedding import build_backend, count_before, nearest
from matchloom.operators.storage import stored
from matchloom.sources import records as R
from matchloom.sources import sinks

#: Models that are trained at the same time.
PARALLEL = 4
EPSILONS = [0.5, 1.0, 2.0, 4.0, 8.0]
THRESHOLDS = [6.5, 7.0, 7.5]
MODES = {"fast": {"folds": 3, "seeds": [3407]}, "final": {"folds": 5, "seeds": splits.SEEDS}}
METRICS = ["auc", "average_precision", "accuracy", "balanced_accuracy", "f1", "precision", "recall"]
RANKED = ["tfidf_cosine", "bm25_score", "embedding_cosine", "dp_embedding_cosine", "kg_skill_coverage", "fused", "learned_fusion"]
RANK_METRICS = ["recall_at_5", "ndcg_at_5", "mrr", "hit_at_1"]
HEURISTICS = {"TF-IDF": "tfidf_cosine", "BM25": "bm25_score", "Embedding": "embedding_cosine", "DP-Embedding": "dp_embedding_cosine", "KG-only": "kg_skill_coverage"}


def records_of(v2: DataFrame) -> DataFrame:
    """Experiment records from raw records by the later inclusion rule; ids are 64-bit hashes of the sample ids."""
    held = v2.where("include_in_matching").withColumn("requirement_text", F.array_join("minimum_requirements", " "))
    return held.select(F.xxhash64("sample_id").alias("idx"), "sample_id", "source_file", "filename_category", F.col("candidate_text").alias("resume_text"), "job_text", "requirement_text", "raw_score",
                       "additional_info", "minimum_requirements", "macro_dict", "micro_dict")


def vectors_of(records: DataFrame, backend: object | None = None, **svd: int) -> DataFrame:
    """``idx, rv, jv``: vectors of resume and job, from a backend that is fitted on both."""
    sides = [records.select(F.col("idx").alias("id"), F.col(c).alias("text")) for c in ("resume_text", "job_text")]
    both = sides[0].select(F.concat(F.lit("r"), "id").alias("id"), "text").unionByName(sides[1].select(F.concat(F.lit("j"), "id").alias("id"), "text"))
    fitted = (backend or build_backend(**svd)).fit(both)
    v = fitted.transform(both)
    side = lambda s, out: v.where(F.col("id").startswith(s)).select(F.expr("cast(substr(id, 2) as long)").alias("idx"), F.col("vector").alias(out))
    return side("r", "rv").join(side("j", "jv"), "idx")


def private_scores(vectors: DataFrame, seeds: list[int] | None = None, epsilons: list[float] = EPSILONS, clip: float = 1.0, sensitivity: float | None = None, resume: str = "idx", job: str = "idx") -> DataFrame:
    """``idx, seed, epsilon, dp`` from keyed noise: it hangs on the record's id and the seed, not on its place in a table.

    ``resume`` and ``job`` name the ids of the two vectors where those are of different records. Without ``seeds`` each row has its own, in ``seed``.
    """
    d = lambda a, b: V.dot(F.col(a), F.col(b))
    clipped = lambda c: V.scaled(F.col(c), V.clip_scale(V.norm(F.col(c)), clip))
    keys = list(dict.fromkeys([resume, job]))
    seeded = vectors if seeds is None else vectors.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    z = seeded.select(
        *keys, "seed", clipped("rv").alias("a"), clipped("jv").alias("b"), V.keyed_noise(F.size("rv"), F.col("seed"), F.lit("resume"), F.col(resume)).alias("za"), V.keyed_noise(F.size("jv"), F.col("seed") + 1, F.lit("job"), F.col(job)).alias("zb"))
    p = z.select(*keys, "seed", d("a", "b").alias("cc"), (d("a", "zb") + d("za", "b")).alias("cz"), d("za", "zb").alias("zz"), d("a", "a").alias("aa"), (2 * d("a", "za")).alias("az"), d("za", "za").alias("azz"), d("b", "b").alias("bb"), (2 * d("b", "zb")).alias("bz"), d("zb", "zb").alias("bzz"))
    s, c = F.col("sigma"), F.col
    cosine = V.cosine_of(c("cc") + s * c("cz") + s * s * c("zz"), F.sqrt(c("aa") + s * c("az") + s * s * c("azz")), F.sqrt(c("bb") + s * c("bz") + s * s * c("bzz")))
    swept = p.withColumn("epsilon", F.explode(F.array(*map(F.lit, epsilons)))).withColumn("sigma", V.sigma_column(F.col("epsilon"), sensitivity=sensitivity or clip))
    return swept.select(*keys, "seed", "epsilon", cosine.alias("dp"))


def feature_table(records: DataFrame, threshold: float = 7.0, seeds: list[int] | None = None, epsilons: list[float] = EPSILONS, backend: object | None = None, max_features: int = 12_000, **svd: int) -> tuple[DataFrame, DataFrame]:
    """All features of each record's own pair, a private column for each budget and seed among them; and the vectors."""
    seeds = seeds or splits.SEEDS
    left = records.select(F.col("idx").alias("l"), F.col("resume_text").alias("text"))
    right = records.select(F.col("idx").alias("r"), F.col("job_text").alias("text"))
    own = records.select(F.col("idx").alias("l"), F.col("idx").alias("r"))
    tfidf = lexical.tfidf_pairs(left, right, own, cap=max_features).select(F.col("l").alias("idx"), F.col("tfidf").alias("tfidf_cosine"))
    postings, _ = lexical.bm25_index(right.withColumnRenamed("r", "job"), [], "job")
    bm25 = lexical.bm25_scores(left.select(F.col("l").alias("query"), F.col("l").alias("job"), "text"), "query", postings, [], "job", paired=True).select(F.col("query").alias("idx"), F.col("bm25").alias("bm25_score"))
    vectors = stored(vectors_of(records, backend, **svd), "vectors")
    emb = vectors.select("idx", V.cosine(F.col("rv"), F.col("jv")).alias("embedding_cosine"))
    wide = private_scores(vectors, seeds, epsilons).groupBy("idx").agg(*(
        F.max(F.when((F.col("epsilon") == e) & (F.col("seed") == s), F.col("dp"))).alias(f"dp_embedding_cosine_epsilon_{str(float(e)).replace('.', '_')}_seed_{s}") for e, s in product(epsilons, seeds)))
    default = fusion.score_column(wide, 2.0 if 2.0 in epsilons else epsilons[0], seeds[0])
    tokens = records.select("idx", T.tokenize(F.col("resume_text")).alias("rt"), T.tokenize(F.col("job_text")).alias("jt"), T.token_set(F.col("requirement_text")).alias("q"))
    sets = tokens.select("idx", F.array_distinct("rt").alias("r"), F.array_distinct("jt").alias("c"), "q", F.size("rt").cast("long").alias("resume_length"), F.size("jt").cast("long").alias("jd_length"))
    kg = sets.select("idx", *(c.alias(n) for n, c in T.pair_features(F.col("r"), F.col("c"), F.col("q")).items()), "resume_length", "jd_length")
    base = records.drop("resume_text", "job_text", "requirement_text", "additional_info", "minimum_requirements", "macro_dict", "micro_dict").withColumn("binary_label", fusion.label_of(F.col("raw_score"), threshold))
    out = base.join(tfidf, "idx").join(bm25, "idx", "left").join(emb, "idx").join(kg, "idx").join(wide, "idx")
    out = out.withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0))).withColumn("dp_embedding_cosine", F.col(default))
    return stored(out, "features"), vectors


def heuristic_scores(df: DataFrame, scope: list[str], scaled: bool = True) -> DataFrame:
    """Adds ``hand_fusion``, the hand-set fusion, to the single scores, as columns named by method."""
    named = df.withColumns({m: F.col(c) for m, c in HEURISTICS.items()})
    parts = {"DP-Embedding": 0.45, "KG-only": 0.45, "BM25": 0.10}
    return fusion.fuse(named, parts, "hand_fusion", scope, scale=scaled)


def classification_rows(scores: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """All classification metrics of long rows ``keys, label, score``; scores are cut after scaling within ``keys``."""
    held = scores.withColumn("score", F.round("score", 9)).withColumn("label", F.col(label))
    auc, ap = metrics.roc_auc(held, keys).select(*keys, "auc"), metrics.average_precision(held, keys)
    cut = metrics.confusion(fusion.predicted(held, keys), keys).drop("tp", "fp", "tn", "fn")
    return auc.join(ap, keys).join(cut, keys)


def oriented_heuristics(folded: DataFrame, keys: list[str], label: str = "binary_label") -> DataFrame:
    """``keys, method, label, score`` of test rows, turned by each split's training part. ``folded`` has ``keys`` and ``is_test``."""
    methods = [*HEURISTICS, "hand_fusion"]
    wide = heuristic_scores(folded, [*keys, "is_test"])
    long = fusion.to_long(wide, [*keys, "is_test", "idx", label], methods).withColumn("label", F.col(label)).withColumn("score", F.round("score", 9))
    turned = fusion.directions(long.where(~F.col("is_test")), [*keys, "method"])
    return stored(fusion.oriented(long.where("is_test"), turned, [*keys, "method"]).select(*keys, "method", "label", "score"), "oriented")


def fold_rows(table: DataFrame, mode: str, label: str = "binary_label") -> DataFrame:
    """Each row once for each seed and fold, with ``is_test``."""
    folds = splits.fold_count(splits.smallest_class(table, label), MODES[mode]["folds"])
    held = splits.stratified_folds(table, "idx", label, folds, MODES[mode]["seeds"]).withColumnRenamed("fold", "own")
    spread = held.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("is_test", F.col("fold") == F.col("own")).drop("own")
    return stored(spread, "folds")


def _splits(held: DataFrame) -> list[tuple[int, int]]:
    return sorted((r["seed"], r["fold"]) for r in held.select("seed", "fold").distinct().collect())


def _each(job: Callable[[tuple], Any], keys: list[tuple]) -> dict:
    """The result of each key's Spark jobs, ``PARALLEL`` keys at a time: small jobs of one key leave most of a cluster idle."""
    with ThreadPoolExecutor(PARALLEL) as threads:
        return dict(zip(keys, threads.map(job, keys), strict=True))


def fitted_models(held: DataFrame, features: list[str], label: str = "binary_label", models: tuple[str, ...] = learn.CLASSIFIERS, small: bool = False) -> dict:
    """(name, model) of each (seed, fold), from its training rows."""
    rows = lambda seed, fold: held.where((F.col("seed") == seed) & (F.col("fold") == fold) & ~F.col("is_test"))
    return _each(lambda k: learn.train_classifier(rows(*k), features, label, k[0], "idx", models, small), _splits(held))


def learned_rows(held: DataFrame, features: list[str], method: str, label: str = "binary_label", models: tuple[str, ...] = learn.CLASSIFIERS, small: bool = False, fitted: dict | None = None) -> tuple[DataFrame, list[dict]]:
    """``seed, fold, method, label, score`` of test rows under the learned fusion, and the importances of every fitted model."""
    parts, importances = [], []
    for (seed, fold), (name, model) in (fitted or fitted_models(held, features, label, models, small)).items():
        rows = held.where((F.col("seed") == seed) & (F.col("fold") == fold))
        scored = learn.with_probability(model, rows.where("is_test"), "score").select("seed", "fold", F.lit(method).alias("method"), F.col(label).alias("label"), "score")
        parts.append(stored(scored, "learned"))
        importances += [{"model": name, "feature": f, "importance": v} for f, v in learn.feature_importance(model).items()]
    return reduce(DataFrame.unionByName, parts), importances


def core_prediction(table: DataFrame, mode: str = "fast", small: bool = False, models: tuple[str, ...] = learn.CLASSIFIERS, regressors: tuple[str, ...] = learn.REGRESSORS) -> dict[str, DataFrame]:
    """Classification, score prediction, ablation, importances and correlations."""
    spark = table.sparkSession
    held = fold_rows(table, mode)
    keys = ["seed", "fold", "method"]
    learned, importances = learned_rows(held, learn.FEATURES, "learned_fusion", models=models, small=small)
    scores = oriented_heuristics(held, ["seed", "fold"]).unionByName(learned)
    binary = metrics.mean_std(classification_rows(scores, keys), ["method"], METRICS)

    wide = stored(heuristic_scores(held.where("is_test"), ["seed", "fold"]), "heuristics")
    raw = fusion.to_long(wide, ["seed", "fold", "idx", "raw_score"], [*HEURISTICS, "hand_fusion"])
    part = lambda seed, fold: held.where((F.col("seed") == seed) & (F.col("fold") == fold))
    regressed = _each(lambda k: learn.train_regressor(part(*k).where(~F.col("is_test")), learn.FEATURES, "raw_score", k[0], "idx", regressors, small), _splits(held))
    for (seed, fold), (_, model) in regressed.items():
        rows = part(seed, fold)
        raw = raw.unionByName(stored(learn.with_prediction(model, rows.where("is_test"), "score").select("seed", "fold", "idx", "raw_score", F.lit("learned_fusion").alias("method"), "score"), "regressed"))
    regression = metrics.errors(raw, keys, "score", "raw_score").join(metrics.correlations(raw.withColumn("score", F.round("score", 9)), keys, "score", "raw_score"), keys)

    logistic = ("LogisticRegression",)
    settings = {"full": learn.FEATURES, "without_dp": learn.NON_DP_FEATURES, "without_knowledge": learn.NO_KG_FEATURES, "embedding_only": ["embedding_cosine"], "knowledge_only": learn.KG_FEATURES}
    ablated = reduce(DataFrame.unionByName, (learned_rows(held, f, name, models=logistic)[0] for name, f in settings.items()))
    hand = fusion.to_long(wide, ["seed", "fold", "binary_label"], ["hand_fusion"]).select("seed", "fold", F.lit("without_learned_fusion").alias("method"), F.col("binary_label").alias("label"), "score")
    ablation = metrics.mean_std(classification_rows(ablated.unionByName(hand), keys).withColumnRenamed("method", "setting"), ["setting"], METRICS)

    top = spark.createDataFrame(importances).groupBy("model", "feature").agg(F.avg("importance").alias("importance_mean"), F.stddev_pop("importance").alias("importance_std")).orderBy(F.desc("importance_mean"), "feature")
    long = fusion.to_long(table.withColumns({f: F.col(f).cast("double") for f in learn.FEATURES}), ["idx", "raw_score", "binary_label"], learn.FEATURES, "feature", "value").withColumn("value", F.round("value", 9))
    correlation = metrics.correlations(long, ["feature"], "value", "raw_score").join(
        metrics.correlations(long, ["feature"], "value", "binary_label").select("feature", F.col("spearman").alias("spearman_label")), "feature")
    return {"binary": binary, "score": metrics.mean_std(regression, ["method"], ["mae", "rmse", "pearson", "spearman"]), "ablation": ablation, "importance": top, "correlation": correlation}


def _with_dp(table: DataFrame, epsilon: float, seed: int) -> DataFrame:
    return table.withColumn("dp_embedding_cosine", F.col(fusion.score_column(table, epsilon, seed)))


def privacy_sweep(table: DataFrame, mode: str = "fast", epsilons: list[float] = EPSILONS, small: bool = False) -> DataFrame:
    """The learned fusion at each budget, with each seed's own noise."""
    parts = []
    for e in epsilons:
        for seed in MODES[mode]["seeds"]:
            held = fold_rows(_with_dp(table, e, seed), mode).where(F.col("seed") == seed)
            parts.append(learned_rows(held, learn.FEATURES, "learned_fusion", small=small)[0].withColumn("epsilon", F.lit(e)))
    rows = classification_rows(reduce(DataFrame.unionByName, parts), ["epsilon", "seed", "fold", "method"])
    return metrics.mean_std(rows, ["epsilon", "method"], METRICS).withColumn("sigma", V.sigma_column(F.col("epsilon")))


def _own_dp(held: DataFrame, epsilon: float, mode: str) -> DataFrame:
    """``held`` with each seed's own private column as ``dp_embedding_cosine``."""
    return held.withColumn("dp_embedding_cosine", F.coalesce(*(F.when(F.col("seed") == s, F.col(fusion.score_column(held, epsilon, s))) for s in MODES[mode]["seeds"])))


def _item_scores(records: DataFrame, vectors: DataFrame, pairs: DataFrame, max_features: int = 12_000) -> DataFrame:
    """Features of arbitrary pairs ``query, cand``, all but the private one: the query's resume against the candidate's job."""
    texts = records.select(F.col("idx").alias("query"), T.token_set(F.col("resume_text")).alias("r"), F.size(T.tokenize(F.col("resume_text"))).cast("long").alias("resume_length"))
    jobs = records.select(F.col("idx").alias("cand"), T.token_set(F.col("job_text")).alias("c"), T.token_set(F.col("requirement_text")).alias("q"), F.size(T.tokenize(F.col("job_text"))).cast("long").alias("jd_length"))
    a, b = vectors.select(F.col("idx").alias("query"), "rv"), vectors.select(F.col("idx").alias("cand"), "jv")
    p = pairs.join(texts, "query").join(jobs, "cand").join(a, "query").join(b, "cand")
    p = p.select("query", "cand", V.cosine(F.col("rv"), F.col("jv")).alias("embedding_cosine"), *(x.alias(n) for n, x in T.pair_features(F.col("r"), F.col("c"), F.col("q")).items()), "resume_length", "jd_length")
    left, right = (records.select(F.col("idx").alias(k), F.col(t).alias("text")) for k, t in (("l", "resume_text"), ("r", "job_text")))
    tfidf = lexical.tfidf_scores(left, right, pairs.select(F.col("query").alias("l"), F.col("cand").alias("r")), cap=max_features).select(F.col("l").alias("query"), F.col("r").alias("cand"), F.col("tfidf").alias("tfidf_cosine"))
    postings, _ = lexical.bm25_index(records.select(F.col("idx").alias("cand"), F.col("job_text").alias("text")), [], "cand")
    asked = pairs.join(records.select(F.col("idx").alias("query"), F.col("resume_text").alias("text")), "query")
    bm25 = lexical.bm25_scores(asked, "query", postings, [], "cand", paired=True)
    return p.join(tfidf, ["query", "cand"]).join(bm25.select("query", "cand", F.col("bm25").alias("bm25_score")), ["query", "cand"], "left").withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0)))


def split_pools(held: DataFrame, vectors: DataFrame, negative_type: str) -> DataFrame:
    """``seed, fold, query, pos, cand``: pools of each split's test rows; hard ones by vector, of all other test rows where negatives are too few."""
    parts = []
    for seed, fold in _splits(held):
        rows = held.where((F.col("seed") == seed) & (F.col("fold") == fold) & F.col("is_test")).select("idx", "binary_label")
        if negative_type == "random":
            pool = pools.random_pools(rows, "idx", "binary_label", seed)
        else:
            others = rows.where("binary_label <> 1")
            positive = vectors.join(rows.where("binary_label = 1"), "idx").select(F.col("idx").alias("id"), F.col("rv").alias("v"))
            source = vectors.join(others if others.count() >= pools.NEGATIVES else rows, "idx").select(F.col("idx").alias("id"), F.col("jv").alias("v"))
            near = nearest(positive, source, pools.NEGATIVES).select(F.col("id").alias("query"), F.col("other").alias("cand"), F.col("cosine").alias("similarity"))
            pool = pools.hard_pools(positive.select(F.col("id").alias("query")), near)
        parts.append(stored(pool.select(F.lit(seed).alias("seed"), F.lit(fold).alias("fold"), "query", "pos", "cand"), "pool"))
    return reduce(DataFrame.unionByName, parts)


def pool_scores(records: DataFrame, vectors: DataFrame, pool: DataFrame, fitted: dict, epsilon: float = 2.0, scaled: bool = True, max_features: int = 12_000) -> DataFrame:
    """``pool`` with every feature, the seed's private score among them, and ``fused`` and ``learned_fusion``, the hand-set and the learned fusion."""
    items = _item_scores(records, vectors, pool.select("query", "cand").distinct(), max_features)
    asked = pool.select("seed", "query", "cand").distinct().join(vectors.select(F.col("idx").alias("query"), "rv"), "query").join(vectors.select(F.col("idx").alias("cand"), "jv"), "cand")
    private = private_scores(asked, epsilons=[epsilon], resume="query", job="cand").select("seed", "query", "cand", F.col("dp").alias("dp_embedding_cosine"))
    scored = pool.join(items, ["query", "cand"]).join(private, ["seed", "query", "cand"])
    named = scored.withColumns({"dp": F.col("dp_embedding_cosine"), "kg": F.col("kg_skill_coverage"), "bm25": F.col("bm25_score")})
    fused = stored(fusion.fuse(named, fusion.PAIR_WEIGHTS, "fused", ["seed", "fold", "query"], scale=scaled), "pool_scores")
    return reduce(DataFrame.unionByName, (learn.with_probability(model, fused.where((F.col("seed") == seed) & (F.col("fold") == fold)), "learned_fusion") for (seed, fold), (_, model) in fitted.items()))


def rank_rows(scores: DataFrame, methods: list[str]) -> DataFrame:
    """Mean rank metrics of each split and method, over pools with a column for each method."""
    long = fusion.to_long(scores.withColumns({m: F.col(m).cast("double") for m in methods}), ["seed", "fold", "query", "pos"], methods).withColumn("score", F.round("score", 9))
    return pools.mean_rank_metrics(pools.rank_of_own(long, ["seed", "fold", "method", "query"]), ["seed", "fold", "method"])


def sampled_ranking(records: DataFrame, table: DataFrame, vectors: DataFrame, mode: str = "fast", negative_type: str = "hard", scaled: bool = True, epsilon: float = 2.0, models: tuple[str, ...] = learn.CLASSIFIERS, small: bool = False,
                    fitted: dict | None = None, max_features: int = 12_000) -> DataFrame:
    """Rank metrics of each method over pools of one own job and 19 others, nearest by vector or drawn at random, of each split's test rows.

    Mean and deviation over seeds and folds; ``queries`` is their sum. Models are trained on each split's training rows, unless ``fitted`` has them.
    """
    held = _own_dp(fold_rows(table, mode), epsilon, mode)
    fitted = fitted or fitted_models(held, learn.FEATURES, models=models, small=small)
    scores = pool_scores(records, vectors, split_pools(held, vectors, negative_type), fitted, epsilon, scaled, max_features)
    rows = stored(rank_rows(scores, RANKED), "ranks")
    queries = rows.groupBy("method").agg(F.sum("queries").alias("queries"))
    return metrics.mean_std(rows, ["method"], RANK_METRICS).join(queries, "method").withColumn("negative_type", F.lit(negative_type)).orderBy("method")


def threshold_experiment(table: DataFrame, mode: str = "fast", thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Oriented heuristics under each threshold of the raw score, and its class counts; ``threshold_tasks`` has the learned fusion."""
    parts = []
    spread = table.where("raw_score is not null").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    counts = spread.groupBy("threshold").agg(F.count_if(F.col("raw_score") >= F.col("threshold")).alias("positives"), F.count_if(F.col("raw_score") < F.col("threshold")).alias("negatives"), F.count("*").alias("rows"))
    for t in thresholds:
        held = fold_rows(table.withColumn("binary_label", fusion.label_of(F.col("raw_score"), t)), mode)
        parts.append(stored(classification_rows(oriented_heuristics(held, ["seed", "fold"]), ["seed", "fold", "method"]).withColumn("threshold", F.lit(t)), "threshold"))
    return metrics.mean_std(reduce(DataFrame.unionByName, parts), ["threshold", "method"], METRICS).join(counts, "threshold").orderBy("threshold", "method")


def threshold_tasks(records: DataFrame, table: DataFrame, vectors: DataFrame, mode: str = "fast", thresholds: list[float] = THRESHOLDS, epsilon: float = 2.0, models: tuple[str, ...] = learn.CLASSIFIERS, small: bool = False, max_features: int = 12_000) -> tuple[DataFrame, DataFrame]:
    """The learned fusion, trained anew at each threshold and split with the seed's own private column: as a binary task, and on hard pools."""
    binary, ranking = [], []
    for t in thresholds:
        held = _own_dp(fold_rows(table.withColumn("binary_label", fusion.label_of(F.col("raw_score"), t)), mode), epsilon, mode)
        fitted = fitted_models(held, learn.FEATURES, models=models, small=small)
        rows, _ = learned_rows(held, learn.FEATURES, "learned_fusion", fitted=fitted)
        binary.append(stored(classification_rows(rows, ["seed", "fold", "method"]).withColumn("threshold", F.lit(t)), "threshold"))
        scores = pool_scores(records, vectors, split_pools(held, vectors, "hard"), fitted, epsilon, max_features=max_features)
        ranking.append(stored(rank_rows(scores, ["learned_fusion"]).withColumn("threshold", F.lit(t)), "threshold"))
    keys = ["threshold", "method"]
    ranks = metrics.mean_std(reduce(DataFrame.unionByName, ranking), keys, RANK_METRICS).withColumn("negative_type", F.lit("hard"))
    return metrics.mean_std(reduce(DataFrame.unionByName, binary), keys, METRICS), ranks


def robust_validation(table: DataFrame, mode: str = "fast", small: bool = False, models: tuple[str, ...] = learn.CLASSIFIERS) -> DataFrame:
    """Row-level folds, repeated hold-outs and, where groups allow, grouped folds, of heuristics and the learned fusion."""
    keys = ["seed", "fold"]
    protocols = {"row_cv": fold_rows(table, mode).where("seed = 3407")}
    seeds = splits.HOLDOUT_SEEDS if mode == "final" else splits.HOLDOUT_SEEDS[:2]
    protocols["holdout"] = splits.stratified_holdout(table, "idx", "binary_label", seeds=seeds).withColumn("fold", F.lit(0))
    for column in splits.group_columns(table):
        grouped = splits.group_folds(table, column)
        if grouped is not None:
            spread = grouped.withColumnRenamed("fold", "own").withColumn("seed", F.lit(0)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits.FOLDS - 1))))
            protocols[f"group_{column}"] = spread.withColumn("is_test", F.col("fold") == F.col("own")).drop("own")
    parts = []
    for name, held in protocols.items():
        scores = oriented_heuristics(held, keys).unionByName(learned_rows(held, learn.FEATURES, "learned_fusion", models=models, small=small)[0])
        parts.append(stored(classification_rows(scores, [*keys, "method"]).withColumn("protocol", F.lit(name)), "protocol"))
    return metrics.mean_std(reduce(DataFrame.unionByName, parts), ["protocol", "method"], METRICS)


def pairwise_in_sample(table: DataFrame, seeds: list[int] | None = None, epsilon: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The first generation's comparison: scores turned by the labels that judge them; metrics by method, and the direction report."""
    parts = []
    for s in seeds or splits.SEEDS:
        wide = heuristic_scores(_with_dp(table, epsilon, s), [])
        parts.append(fusion.to_long(wide, ["idx", "binary_label"], [*HEURISTICS, "hand_fusion"]).withColumns({"seed": F.lit(s), "label": F.col("binary_label"), "score": F.round("score", 9)}))
    long = reduce(DataFrame.unionByName, parts)
    report = fusion.directions(long, ["seed", "method"])
    turned = fusion.oriented(long, report, ["seed", "method"])
    return metrics.mean_std(classification_rows(turned, ["seed", "method"]), ["method"], METRICS), report


def score_matrix(records: DataFrame, vectors: DataFrame, pairs: DataFrame | None = None, epsilon: float = 2.0, seed: int = 3407, max_features: int = 12_000) -> DataFrame:
    """``query, cand`` and the five single scores of all pairs, or of ``pairs``: TF-IDF, BM25, Embedding, DP-Embedding (noise, clipped again), KG."""
    ids = records.select(F.col("idx").alias("query"))
    asked = stored(matrices.all_pairs(ids, ids.withColumnRenamed("query", "cand")) if pairs is None else pairs.select("query", "cand").distinct(), "pairs")
    texts = lambda key, column: records.select(F.col("idx").alias(key), F.col(column).alias("text"))
    tfidf = lexical.tfidf_scores(texts("l", "resume_text"), texts("r", "job_text"), asked.select(F.col("query").alias("l"), F.col("cand").alias("r")), cap=max_features).select(F.col("l").alias("query"), F.col("r").alias("cand"), F.col("tfidf").alias("TF-IDF"))
    postings, _ = lexical.bm25_index(texts("cand", "job_text"), [], "cand")
    bm25 = lexical.bm25_scores(asked.join(texts("query", "resume_text"), "query"), "query", postings, [], "cand", paired=True).select("query", "cand", F.col("bm25").alias("BM25"))
    found = tfidf.join(bm25, ["query", "cand"], "left").withColumn("BM25", F.coalesce("BM25", F.lit(0.0)))
    found = found.join(matrices.vector_scores(vectors, asked, "Embedding"), ["query", "cand"])
    found = found.join(matrices.vector_scores(stored(matrices.noisy_vectors(vectors, epsilon, seed), "noisy"), asked, "DP-Embedding"), ["query", "cand"])
    known = matrices.knowledge_scores(records, asked).select("query", "cand", F.col("overall").alias("KG"), "consistency")
    return stored(found.join(known, ["query", "cand"]), "score_matrix")


RETRIEVAL = ["TF-IDF", "BM25", "Embedding", "retrieval_fusion", "DP-Embedding", "hand_fusion"]


def full_retrieval(records: DataFrame, vectors: DataFrame, epsilon: float = 2.0, seed: int = 3407, max_features: int = 12_000, threshold: float = 7.0) -> DataFrame:
    """Each resume against all jobs by six methods: rank metrics of positives, consistency of every resume's first job, and the scores' mean and deviation.

    Fusions are of scores scaled over the whole matrix. The matrix is quadratic; ``vector_retrieval`` is the one for many records.
    """
    grid = score_matrix(records, vectors, None, epsilon, seed, max_features)
    single = {"tfidf": "TF-IDF", "bm25": "BM25", "embedding": "Embedding", "dp": "DP-Embedding", "kg": "KG"}
    scaled = fusion.scaled_all(grid.select("query", "cand", *(F.col(c).alias(n) for n, c in single.items())), list(single))
    wide = scaled.select("query", "cand", *(F.col(n).alias(c) for n, c in single.items() if n != "kg"), fusion.weighted_sum(fusion.RAG_WEIGHTS, "_scaled").alias("retrieval_fusion"), fusion.weighted_sum(fusion.RETRIEVAL_DP_WEIGHTS, "_scaled").alias("hand_fusion"))
    long = stored(fusion.to_long(wide, ["query", "cand"], RETRIEVAL).withColumn("score", F.round("score", 9)), "retrieval")
    ranks = stored(matrices.ranks_in_matrix(long, ["method", "query"]), "retrieval_ranks")
    positive = records.where(fusion.label_of(F.col("raw_score"), threshold) == 1).select(F.col("idx").alias("query"))
    judged = pools.mean_rank_metrics(ranks.join(positive, "query"), ["method"])
    consistent = ranks.join(grid.select("query", F.col("cand").alias("top"), "consistency"), ["query", "top"]).groupBy("method").agg(F.avg("consistency").alias("consistency"))
    spread = long.groupBy("method").agg(F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"))
    return judged.join(consistent, "method").join(spread, "method").orderBy("method")


def first_ranking(records: DataFrame, table: DataFrame, vectors: DataFrame, negative_type: str = "random", seeds: list[int] | None = None, epsilon: float = 2.0, label: str = "binary_label") -> DataFrame:
    """The first generation's pools: TF-IDF and BM25 from each pool's own corpus, fusion scaled within the pool, scores turned by in-sample direction.

    Hard negatives are the nearest by TF-IDF. Rank metrics and the consistency of the first job, mean and deviation over seeds.
    """
    parts = []
    rows = table.select("idx", label)
    positive, negative = (rows.where(F.col(label) == c).select("idx") for c in (1, 0))
    for seed in seeds or splits.SEEDS:
        if negative_type == "random":
            pool = pools.random_pools(rows, "idx", label, seed)
        else:
            asked = matrices.all_pairs(positive.select(F.col("idx").alias("query")), negative.select(F.col("idx").alias("cand")))
            texts = lambda key, column: records.select(F.col("idx").alias(key), F.col(column).alias("text"))
            similar = lexical.tfidf_scores(texts("l", "resume_text"), texts("r", "job_text"), asked.select(F.col("query").alias("l"), F.col("cand").alias("r")))
            pool = pools.hard_pools(positive.select(F.col("idx").alias("query")), similar.select(F.col("l").alias("query"), F.col("r").alias("cand"), F.col("tfidf").alias("similarity")))
        pool = stored(pool, "pool")
        jobs = pool.join(records.select(F.col("idx").alias("cand"), F.col("job_text").alias("text")), "cand")
        resumes = pool.select("query").distinct().join(records.select(F.col("idx").alias("query"), F.col("resume_text").alias("text")), "query")
        corpus = resumes.select("query", F.lit(0).alias("side"), F.col("query").alias("id"), "text").unionByName(jobs.select("query", F.lit(1).alias("side"), F.col("cand").alias("id"), "text"))
        tfidf = lexical.tfidf_scoped(corpus, ["query"]).select("query", F.col("id").alias("cand"), F.col("tfidf").alias("TF-IDF"))
        postings, _ = lexical.bm25_index(jobs.select("query", "cand", "text"), ["query"], "cand")
        tokens = resumes.select("query", F.explode(T.tokenize(F.col("text"))).alias("t")).select("query", F.xxhash64("t").alias("term"))
        bm25 = tokens.join(postings, ["query", "term"]).groupBy("query", "cand").agg(F.sum("weight").alias("BM25"))
        met = pool.select("query", "cand").join(vectors.select(F.col("idx").alias("query"), "rv"), "query").join(vectors.select(F.col("idx").alias("cand"), "jv"), "cand")
        private = private_scores(met, [seed], [epsilon], resume="query", job="cand").select("query", "cand", F.col("dp").alias("DP-Embedding"))
        known = matrices.knowledge_scores(records, pool.select("query", "cand")).select("query", "cand", F.col("overall").alias("KG-only"), "consistency")
        wide = pool.join(tfidf, ["query", "cand"]).join(bm25, ["query", "cand"], "left").withColumn("BM25", F.coalesce("BM25", F.lit(0.0))) \
            .join(matrices.vector_scores(vectors, pool.select("query", "cand"), "Embedding"), ["query", "cand"]).join(private, ["query", "cand"]).join(known, ["query", "cand"])
        fused = stored(fusion.fuse(wide, {"DP-Embedding": 0.45, "KG-only": 0.45, "BM25": 0.10}, "hand_fusion", ["query"]), "first_pools")
        _, report = pairwise_in_sample(table, [seed], epsilon)
        methods = [*HEURISTICS, "hand_fusion"]
        long = fusion.oriented(fusion.to_long(fused, ["query", "pos", "cand"], methods), report, ["method"]).withColumn("score", F.round("score", 9))
        ranks = pools.mean_rank_metrics(pools.rank_of_own(long, ["method", "query"]), ["method"])
        top = pools.top_of_pool(long, ["method", "query"]).join(fused.select("query", F.col("cand").alias("top"), "consistency"), ["query", "top"])
        parts.append(stored(ranks.join(top.groupBy("method").agg(F.avg("consistency").alias("consistency")), "method").withColumn("seed", F.lit(seed)), "first_ranks"))
    every = reduce(DataFrame.unionByName, parts)
    return metrics.mean_std(every, ["method"], [*RANK_METRICS, "consistency"]).withColumn("negative_type", F.lit(negative_type))


def vector_retrieval(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each positive resume against all jobs by vector: the own job's rank among all of them, ties to the smaller id."""
    jobs = vectors.select(F.col("idx").alias("id"), F.col("jv").alias("v"))
    queries = vectors.join(records.where("raw_score >= 7").select("idx"), "idx")
    own = queries.select(F.col("idx").alias("id"), F.col("rv").alias("v"), F.round(V.cosine(F.col("rv"), F.col("jv")), 9).alias("own"))
    return pools.mean_rank_metrics(count_before(own, jobs).select((F.col("before") + 1).cast("int").alias("rank")), [])


def summarize(results: dict[str, DataFrame]) -> str:
    """All result tables as one Markdown text."""
    return "\n".join(f"## {name}\n\n{sinks.markdown_table(df)}" for name, df in results.items())


def run(spark: SparkSession, raw_dir: str, out_dir: str, mode: str = "fast") -> dict[str, DataFrame]:
    """From a directory of raw records to result tables, written as CSV, and a summary."""
    raw = R.read_raw(spark, raw_dir)
    for name, df in R.convert(raw).items():
        sinks.write_jsonl(df, f"{out_dir}/{name}")
    records = stored(records_of(R.v2_records(raw)), "records")
    table, vectors = feature_table(records, seeds=MODES[mode]["seeds"])
    base = sinks.write_table(table, f"{out_dir}/pair_features")
    table = spark.read.parquet(base)
    results = core_prediction(table, mode)
    results |= {"privacy": privacy_sweep(table, mode), "threshold": threshold_experiment(table, mode), "robust": robust_validation(table, mode)}
    results["threshold_learned"], results["threshold_ranking"] = threshold_tasks(records, table, vectors, mode)
    fitted = fitted_models(_own_dp(fold_rows(table, mode), 2.0, mode), learn.FEATURES)
    results |= {f"ranking_{t}": sampled_ranking(records, table, vectors, mode, t, fitted=fitted) for t in ("random", "hard")}
    results |= {f"first_ranking_{t}": first_ranking(records, table, vectors, t, MODES[mode]["seeds"]) for t in ("random", "hard")}
    results["full_retrieval"] = full_retrieval(records, vectors)
    for name, df in results.items():
        sinks.write_csv(f"{out_dir}/{name}", df)
    sinks.write_metadata(f"{out_dir}/metadata.json", {"mode": mode, "rows": table.count(), "epsilons": EPSILONS, "seeds": MODES[mode]["seeds"]})
    return results


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("raw_dir")
    parser.add_argument("out_dir")
    parser.add_argument("--mode", choices=sorted(MODES), default="fast")
    args = parser.parse_args()
    print(summarize(run(SparkSession.builder.getOrCreate(), args.raw_dir, args.out_dir, args.mode)))


if __name__ == "__main__":
    main()
