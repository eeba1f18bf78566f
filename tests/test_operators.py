import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators import embedding, fusion, learn, lexical, matrices, metrics, pools, postings, retrieval, splits
from matchloom.operators.embedding import TfidfSvd, all_cosines, build_backend, nearest, right_vectors
from matchloom.operators.running import running_sums, shuffled_index


@pytest.fixture
def scored(spark):
    random.seed(1)
    rows = [(m, i, round(random.choice([random.random(), 0.5, 0.25]), 3), int(random.random() < 0.3)) for m in ("a", "b") for i in range(120)]
    return rows, spark.createDataFrame(rows, "method string, id int, score double, label int").repartition(5)


def brute_auc(pairs):
    p, n = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)) if p and n else None


def brute_ap(pairs):
    out, seen, hits = 0.0, 0, 0
    total = sum(y for _, y in pairs)
    for s in sorted({s for s, _ in pairs}, reverse=True):
        own = [y for t, y in pairs if t == s]
        seen, hits = seen + len(own), hits + sum(own)
        out += sum(own) / total * hits / seen
    return out


def test_worked_values(spark):
    s, y = [.9, .8, .8, .3, .1], [1, 0, 1, 0, 0]
    df = spark.createDataFrame(list(zip(s, y, strict=True)), "score double, label int")
    assert metrics.roc_auc(df, []).first()["auc"] == pytest.approx(0.9166666666666666)
    assert metrics.average_precision(df, []).first()["average_precision"] == pytest.approx(0.8333333333333333)
    cut = fusion.predicted(metrics.minmax(df, [], "score", "m"), []).orderBy(F.desc("m")).collect()
    assert [r["m"] for r in cut] == pytest.approx([1, .875, .875, .25, 0]) and [r["predicted"] for r in cut] == [1, 1, 1, 0, 0]
    flat = spark.createDataFrame([(2.0, 1), (2.0, 0)], "score double, label int")
    assert {r["m"] for r in metrics.minmax(flat, [], "score", "m").collect()} == {0.0} and metrics.roc_auc(flat, []).first()["auc"] == 0.5
    assert metrics.roc_auc(df.where("label = 1"), []).first()["auc"] is None


def test_ranking_metrics_against_brute_force(scored):
    rows, df = scored
    auc = {r["method"]: r["auc"] for r in metrics.roc_auc(df, ["method"]).collect()}
    ap = {r["method"]: r["average_precision"] for r in metrics.average_precision(df, ["method"]).collect()}
    turned = {r["method"]: r for r in fusion.directions(df.withColumn("score", -F.col("score")), ["method"]).collect()}
    for m in ("a", "b"):
        pairs = [(s, y) for k, _, s, y in rows if k == m]
        assert auc[m] == pytest.approx(brute_auc(pairs)) and ap[m] == pytest.approx(brute_ap(pairs)) and turned[m]["auc"] == pytest.approx(1 - auc[m])
        assert turned[m]["direction"] == (-1 if 1 - auc[m] < 0.5 else 1)


def test_correlations(spark):
    random.seed(2)
    rows = [(random.choice([1.0, 2.0, random.random() * 9]), random.random(), 4.0) for _ in range(80)]
    df = spark.createDataFrame(rows, "x double, y double, c double")
    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    def pearson(x, y):
        mx, my = sum(x) / len(x), sum(y) / len(y)
        return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    x, y = [r[0] for r in rows], [r[1] for r in rows]
    got = metrics.correlations(df, [], "x", "y").first()
    assert got["pearson"] == pytest.approx(pearson(x, y)) and got["spearman"] == pytest.approx(pearson(ranks(x), ranks(y)))
    assert tuple(metrics.correlations(df, [], "x", "c").first()) == (None, None)


def test_confusion_and_means(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 0), ("b", 0, 0), ("b", 0, 0)], "k string, predicted int, label int")
    got = {r["k"]: r for r in metrics.confusion(df, ["k"]).collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["f1"], got["a"]["balanced_accuracy"]) == (0.5, 1.0, pytest.approx(2 / 3), 0.75)
    assert (got["b"]["precision"], got["b"]["recall"], got["b"]["f1"], got["b"]["balanced_accuracy"], got["b"]["accuracy"]) == (0, 0, 0, 1.0, 1.0)
    m = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", None), ("x", float("nan")), ("y", 2.0)], "k string, v double")
    assert [tuple(r) for r in metrics.mean_std(m, ["k"], ["v"]).collect()] == [("x", 2.0, 1.0, 4), ("y", 2.0, 0.0, 1)]


def test_running_sums_and_indexes(spark):
    rows = [(i % 3, i * i % 977 + i / 1000, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, x double, v int").repartition(6)
    for r in running_sums(df, ["k"], "x", ["v"]).collect():
        assert r["v_before"] == sum(v for k, x, v in rows if k == r["k"] and x < r["x"]) and r["v_upto"] == r["v_before"] + r["v"]
    hashed = spark.range(300).select((F.col("id") % 2).alias("k"), "id", F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    for k in (0, 1):
        got = sorted((r["pos"], r["h"]) for r in shuffled_index(hashed, ["k"], "h", "id").where(F.col("k") == k).collect())
        assert [p for p, _ in got] == list(range(150)) and [h for _, h in got] == sorted(h for _, h in got)


def test_bm25_and_tfidf_against_plain_loops(spark):
    random.seed(3)
    words = ["spark", "sql", "java", "graph", "model", "the", "data"]
    texts = {i: " ".join(random.choice(words) for _ in range(random.randrange(0, 12))) for i in range(12)}
    jobs = {i: " ".join(random.choice(words) for _ in range(random.randrange(0, 9))) for i in range(5)}
    q, d = (spark.createDataFrame(list(x.items()), f"{n} int, text string") for x, n in ((texts, "q"), (jobs, "d")))
    tok = {i: t.split() for i, t in jobs.items()}
    n, avg = len(jobs), sum(map(len, tok.values())) / len(jobs)
    df = Counter(w for t in tok.values() for w in set(t))
    raw = {w: math.log(n - c + .5) - math.log(c + .5) for w, c in df.items()}
    idfs = {"plus_one": {w: math.log(1 + (n - c + .5) / (c + .5)) for w, c in df.items()}, "okapi_floor": {w: v if v >= 0 else .25 * sum(raw.values()) / len(raw) for w, v in raw.items()}}
    for mode, idf in idfs.items():
        postings, _ = lexical.bm25_index(d, [], "d", mode)
        got = {(r["q"], r["d"]): r["bm25"] for r in lexical.bm25_scores(q, "q", postings, [], "d").collect()}
        for i, t in texts.items():
            for j in jobs:
                want = sum(idf[w] * tok[j].count(w) * 2.5 / (tok[j].count(w) + 1.5 * (.25 + .75 * len(tok[j]) / avg)) for w in t.split() if w in tok[j])
                assert got.get((i, j), 0.0) == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        lexical.bm25_index(d, [], "d", "other")

    def terms(t):
        w = [x for x in t.split() if x != "the"]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    corpus = [terms(t) for t in [*texts.values(), *jobs.values()]]
    seen = Counter(w for c in corpus for w in c)
    def vector(t):
        v = {w: c * (math.log((1 + len(corpus)) / (1 + seen[w])) + 1) for w, c in terms(t).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))
    pairs = spark.createDataFrame([(i, i % 5) for i in texts], "l int, r int")
    got = {r["l"]: r["tfidf"] for r in lexical.tfidf_pairs(q.toDF("l", "text"), d.toDF("r", "text"), pairs).collect()}
    for i, t in texts.items():
        (a, la), (b, lb) = vector(t), vector(jobs[i % 5])
        assert got[i] == pytest.approx(sum(x * b.get(w, 0) for w, x in a.items()) / (la * lb) if la * lb else 0, abs=1e-9)


def test_splits(spark):
    df = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 9).alias("source"))
    rows = splits.stratified_folds(df, "id", "y", 5).collect()
    assert Counter(r["seed"] for r in rows) == dict.fromkeys(splits.SEEDS, 103)
    for seed in splits.SEEDS:
        for y in (0, 1):
            sizes = Counter(r["fold"] for r in rows if r["seed"] == seed and r["y"] == y)
            assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1
    held = splits.stratified_holdout(df, "id", "y", 0.2, [1]).collect()
    assert Counter((r["y"], r["is_test"]) for r in held)[(1, True)] == 5 and Counter((r["y"], r["is_test"]) for r in held)[(0, True)] == 15
    grouped = splits.group_folds(df, "source").collect()
    assert len(grouped) == 103 and all(len({r["fold"] for r in grouped if r["source"] == g}) == 1 for g in range(9))
    assert splits.group_folds(df, "id") is None and splits.group_folds(df, "y") is None and splits.group_columns(df) == ["source"]
    assert [splits.fold_count(n) for n in (0, 1, 2, 3, 4, 5, 50)] == [2, 2, 2, 3, 3, 5, 5]
    assert splits.leaking_columns(["a", "y"], ["y"], ["id"]) == ["y"]


@pytest.mark.parametrize("negatives", [200, 5])
def test_random_pools(spark, negatives):
    df = spark.range(30 + negatives).select("id", (F.col("id") < 30).cast("int").alias("y"))
    rows = pools.random_pools(df, "id", "y", 7).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query"], {})[r["pos"]] = r["cand"]
    assert sorted(by) == list(range(30))
    for q, own in by.items():
        assert own[0] == q and sorted(own) == list(range(20)) and len(set(own.values())) == 20
        assert negatives == 5 or all(c >= 30 for p, c in own.items() if p)


def test_rank_rules(spark):
    rows = [(1, p, s) for p, s in enumerate([0.5, 0.5, 0.9, 0.1])] + [(2, p, 0.3) for p in range(4)] + [(3, 0, None), (3, 1, 0.2)]
    df = spark.createDataFrame(rows, "query int, pos int, score double")
    assert {r["query"]: r["rank"] for r in pools.rank_of_own(df, ["query"]).collect()} == {1: 2, 2: 1, 3: 2}
    assert {r["query"]: r["rank"] for r in pools.rank_of_own(df, ["query"], ties="pessimistic").collect()} == {1: 3, 2: 4, 3: 2}
    ndcg = [pools.mean_rank_metrics(spark.createDataFrame([(k,)], "rank int"), []).first()["ndcg_at_5"] for k in range(1, 7)]
    assert ndcg == pytest.approx([1, .63093, .5, .430677, .386853, 0], abs=1e-5)


def test_fusion(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (2, 1.0, 1.0), (3, 0.5, 0.0)], "id int, dp double, kg double")
    f = {r["id"]: r for r in fusion.largest(fusion.fuse(df, {"dp": 0.6, "kg": 0.4}, "f"), ["dp", "kg"], "m").collect()}
    assert [f[i]["f"] for i in (1, 2, 3)] == pytest.approx([0.4, 0.8, 0.3]) and [f[i]["m"] for i in (1, 2, 3)] == [1, 1, 0.5]
    s = spark.createDataFrame([(None, 4.0), (2.0, None), (2.0, 4.0), (None, None)], "a double, b double").select(fusion.raw_score(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in s.collect()] == [4, 2, 3, None]
    assert fusion.score_column(df.withColumn("dp_embedding_cosine_epsilon_2_0_seed_42", F.lit(1)), 2.0, 42).endswith("2_0_seed_42")
    with pytest.raises(KeyError):
        fusion.score_column(df, 2.0, 42)


def test_embedding(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["spark sql engine", "spark sql tables", "cats purr softly", "cats purr loudly", "", "the"])], "id long, text string")
    v = {r["id"]: r["vector"] for r in TfidfSvd(50, 3).fit(texts).transform(texts).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert dot(0, 1) > 0.4 > 0.1 > abs(dot(0, 2)) and dot(2, 3) > 0.4 and set(v[4]) == {0.0} and dot(0, 0) == pytest.approx(1)
    with pytest.warns(UserWarning, match="tfidf-svd"):
        assert build_backend(prefer_sentences=True).name == "tfidf-svd"
    e = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)], "id long, v array<double>")
    got = {(r["id"], r["rank"]): r["other"] for r in nearest(e, e, 3, block=16).collect()}
    for i in range(40):
        want = sorted((-round(math.cos(i - j), 9), j) for j in range(40) if j != i)[:3]
        assert [got[(i, r + 1)] for r in range(3)] == [j for _, j in want]


def test_svd_has_the_sizes_of_the_final_run_and_the_true_vectors(spark):
    assert (build_backend().max_features, build_backend().components) == (12_000, 96)
    rng = np.random.default_rng(1)
    scale = 0.7 ** np.arange(20)
    dense = rng.normal(size=(90, 20)) * scale
    rows = spark.createDataFrame([(list(range(20)), r.tolist()) for r in dense], "at array<int>, w array<double>").repartition(3)
    got, want = right_vectors(rows, 20, 4), np.linalg.svd(dense)[2][:4].T
    assert got.shape == (20, 4) and np.allclose(np.abs((got * want).sum(axis=0)), 1, atol=1e-6)
    texts = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j * j) % 400}" for j in range(40))) for i in range(150)], "id long, text string")
    fitted = build_backend().fit(texts)
    assert len(fitted.vocabulary) > 2000 and fitted.projection.shape == (len(fitted.vocabulary), 96) and np.allclose(fitted.projection.T @ fitted.projection, np.eye(96))


def test_running_sums_with_an_outlier_and_one_part(spark):
    rows = [(float(i), 1) for i in range(3000)] + [(1e18, 5), (-1e18, 7)]
    got = {r["x"]: (r["v_before"], r["v_upto"]) for r in running_sums(spark.createDataFrame(rows, "x double, v int").repartition(3), [], "x", ["v"]).collect()}
    assert got[-1e18] == (0, 7) and got[1e18] == (3007, 3012) and all(got[float(i)] == (7 + i, 8 + i) for i in range(3000))


def test_many_groups_are_placed_by_hash(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, F.lit("big")).when(F.col("id") < 2990, F.concat(F.lit("g"), (F.col("id") % 400).cast("string"))).alias("source"))
    rows = splits.group_folds(df, "source", largest=10).collect()
    folds = {}
    for r in rows:
        folds.setdefault(r["source"], set()).add(r["fold"])
    assert len(rows) == 2990 and len(folds) == 401 and all(len(f) == 1 for f in folds.values()) and set().union(*folds.values()) == set(range(5))
    rest = Counter(r["fold"] for r in rows if r["source"] != "big")
    assert min(rest.values()) > 200


def test_hot_terms_have_the_same_weights(spark, monkeypatch):
    left = spark.createDataFrame([(i, f"common word{i % 7} common thing{i}") for i in range(60)], "l long, text string")
    right = spark.createDataFrame([(i, f"common word{i} other") for i in range(5)], "r long, text string")
    pairs = left.select("l", (F.col("l") % 5).alias("r"))
    found = []
    for hot in (0, 64, 10**9):
        monkeypatch.setattr(lexical, "HOT", hot)
        found.append(sorted((r["l"], r["r"], round(r["tfidf"], 12)) for r in lexical.tfidf_pairs(left, right, pairs).collect()))
    assert found[0] == found[1] == found[2] and any(t > 0 for *_, t in found[0])
    other = lexical.tfidf_pairs(left, right, pairs, stop_words=["common"]).collect()
    assert sum(r["tfidf"] for r in other) < sum(t for *_, t in found[0])


def test_linear_models_against_their_closed_forms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [1.0, 20.0]
    y = x @ [2.0, -0.1] + rng.normal(size=200)
    label = (rng.random(200) < 1 / (1 + np.exp(-(x @ [1.0, 0.05])))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), float(t), int(c)) for i, ((a, b), t, c) in enumerate(zip(x, y, label, strict=True))], "id long, a double, b double, t double, c int")
    _, ridge = learn.train_regressor(df, ["a", "b"], "t", 1, "id", ("Ridge",))
    centred = x - x.mean(axis=0)
    want = np.linalg.solve(centred.T @ centred + np.eye(2), centred.T @ (y - y.mean()))
    assert np.allclose(ridge.stages[-1].coefficients.toArray(), want, atol=1e-8)
    _, logistic = learn.train_classifier(df, ["a", "b"], "c", 1, "id", ("LogisticRegression",))
    design, w = np.column_stack([x, np.ones(200)]), np.zeros(3)
    weight = np.where(label == 1, 100 / label.sum(), 100 / (200 - label.sum()))
    for _ in range(50):  # Newton's method on the penalised, balanced likelihood
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (weight * (p - label)) + [w[0], w[1], 0]
        hess = design.T @ (design * (weight * p * (1 - p))[:, None]) + np.diag([1.0, 1.0, 0.0])
        w -= np.linalg.solve(hess, grad)
    model = logistic.stages[-1]
    assert np.allclose([*model.coefficients.toArray(), model.intercept], w, atol=1e-4)
    scored = {r["id"]: r["score"] for r in learn.with_probability(logistic, df, "score").collect()}
    assert all(abs(scored[i] - 1 / (1 + np.exp(-design[i] @ w))) < 1e-4 for i in range(200))


def test_knowledge_matrix_equals_the_scores_of_all_pairs_and_moves_no_text(spark):
    resumes = [(i, t) for i, t in enumerate(["python sql spark teamwork", "java", "", None, "sql sql python team lead communication"])]
    jobs = [(10, "python spark java", ["python sql", "", "java"], "team lead", {"sql": 60.0, "team work": 0.0, "!": 5.0}, {"lead": 40.0}),
            (11, "", [], "", None, None), (12, None, None, None, {"java spark": None}, {"python": 10.0}), (13, "sql", ["sql sql"], "sql", {}, {})]
    kinds = "minimum_requirements array<string>, additional_info string, macro_dict map<string,double>, micro_dict map<string,double>"
    r = spark.createDataFrame(resumes, "idx long, resume_text string")
    j = spark.createDataFrame(jobs, f"idx long, job_text string, {kinds}")
    both = r.unionByName(j, allowMissingColumns=True)
    pairs = matrices.all_pairs(r.select(F.col("idx").alias("query")), j.select(F.col("idx").alias("cand")))
    want = sorted(tuple(x) for x in matrices.knowledge_scores(both, pairs).select("query", "cand", "overall", "consistency").collect())
    matrix = matrices.knowledge_matrix(r, j)
    got = sorted(tuple(x) for x in matrix.collect())
    assert len(got) == 20 and [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2:] for x in got], [x[2:] for x in want], atol=1e-12)
    assert "Exchange" not in matrix._jdf.queryExecution().executedPlan().toString()
    assert matrices.knowledge_matrix(r, j.where("false")).count() == 0


def test_blocks_find_the_first_among_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(900, 4)), 1)
    v[::3] = v[0]
    v[5] = np.nan
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    m = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosines = np.where(np.isnan(m @ m.T), -np.inf, np.round(m @ m.T, 9))
    np.fill_diagonal(cosines, -np.inf)
    want = np.argsort(-cosines, axis=1, kind="stable")
    for block in (100, 32_768):
        got = {(r["id"], r["rank"]): r["other"] for r in nearest(e, e, 3, block=block).collect()}
        assert len(got) == 899 * 3 and all([got[i, r + 1] for r in range(3)] == want[i, :3].tolist() for i in range(900) if i != 5)
    pairs = all_cosines(e.where("id > 5 and id < 50"), e.where("id > 800"), "s", block=30)
    moved = {(r["query"], r["cand"]): r["s"] for r in pairs.collect()}
    assert len(moved) == 44 * 99 and all(abs(s - (m @ m.T)[i, j]) < 5.1e-7 for (i, j), s in moved.items())


def test_a_block_of_scores_is_bounded_and_has_no_full_sort():
    rng = np.random.default_rng(6)
    scores = np.round(rng.random((40, 5000)), 3)
    scores[3] = 0.5
    row, at, x = embedding._first(scores.copy(), 5)
    for r in range(40):
        want = np.argsort(-scores[r], kind="stable")[:5]
        assert at[row == r].tolist() == want.tolist() and np.array_equal(x[row == r], scores[r][want])


def test_retrieval_is_judged_without_a_row_for_each_pair(spark):
    random.seed(8)
    words = ["spark", "sql", "java", "graph", "model", "data"]
    text = lambda n: " ".join(random.choice(words) for _ in range(random.randrange(0, n)))
    asked, jobs = [(i, i % 2, i % 5, text(9)) for i in range(30)], [(i, text(6)) for i in range(5)]
    q = spark.createDataFrame(asked, "query long, quality int, own long, text string")
    d = spark.createDataFrame(jobs, "cand long, text string")
    index, _ = lexical.bm25_index(d, [], "cand")
    bm25 = {(r["query"], r["cand"]): r["bm25"] for r in lexical.bm25_scores(q.select("query", "text"), "query", index, [], "cand").collect()}
    tokens = lambda df, out: df.withColumn(out, postings.hashed(T.tokenize(F.col("text"))))
    judged = retrieval.judged(tokens(q, "tokens"), tokens(d, "b").withColumn("b", F.array_distinct("b")), index, {"bm25": 0.55, "kg": 0.45})
    assert "Generate" not in judged._jdf.queryExecution().executedPlan().toString()
    got = {r["method"]: r for r in judged.collect()}
    a, b = [set(x[3].split()) for x in asked], [set(x[1].split()) for x in jobs]
    m = {"jaccard": np.array([[len(x & y) / len(x | y) if x | y else 1.0 for y in b] for x in a]), "kg": np.array([[len(x & y) / len(y) if y else 0.0 for y in b] for x in a]),
         "bm25": np.array([[bm25.get((i, j), 0.0) for j in range(5)] for i in range(30)])}
    m["retrieval_fusion"] = sum(w * (m[k] - m[k].min()) / (m[k].max() - m[k].min()) for k, w in (("bm25", 0.55), ("kg", 0.45)))
    for name, x in m.items():
        x = np.round(x, 9)
        order = np.argsort(-x, axis=1, kind="stable")
        rank = np.array([order[i].tolist().index(i % 5) + 1 for i in range(30) if i % 2])
        assert got[name]["queries"] == 15 and got[name]["mrr"] == pytest.approx((1 / rank).mean()) and got[name]["recall_at_5"] == 1 and got[name]["hit_at_1"] == pytest.approx((rank == 1).mean())
        assert got[name]["consistency"] == pytest.approx(m["jaccard"][np.arange(30), order[:, 0]].mean())
        assert (got[name]["score_mean"], got[name]["score_std"]) == (pytest.approx(x.mean()), pytest.approx(x.std()))


def test_hashed_terms_are_counted_without_an_exchange(spark):
    docs = spark.createDataFrame([(1, None, ["a", "b", "a"]), (2, 5, []), (3, 6, None), (4, 7, ["b"])], "id long, mate long, _t array<string>")
    counts = lexical.term_counts(docs, ["id", "mate"])
    h = {w: spark.range(1).select(F.xxhash64(F.lit(w)).alias("h")).first()["h"] for w in "ab"}
    assert sorted(map(tuple, counts.collect()), key=repr) == sorted([(1, None, h["a"], 2), (1, None, h["b"], 1), (4, 7, h["b"], 1)], key=repr)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
