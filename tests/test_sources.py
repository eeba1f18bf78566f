import json
import math
import os

import pytest
from pyspark.sql import functions as F

from matchloom.operators import lexical, matrices
from matchloom.operators.storage import stored
from matchloom.plans import experiments as X
from matchloom.sources import records as R
from matchloom.sources import sinks as S

TOPICS = [["spark", "sql", "cluster", "join"], ["nurse", "clinic", "patient", "ward"], ["steel", "weld", "crane", "site"]]


def record(i, match=True, **change):
    own, other = TOPICS[i % 3], TOPICS[(i + 1) % 3]
    job = own if match else other
    out = {"input": {"job_description": f"we need {' '.join(job)} skill{i % 5}", "macro_dict": {job[0]: 60, job[1]: 40}, "micro_dict": {job[2]: None}, "additional_info": "on site", "minimum_requirements": [f"{job[0]} {job[1]}", job[3]], "resume": f"worked with {' '.join(own)} for {i} years skill{i % 5}"},
           "output": {"justification": ["fine"], "valid_resume_and_jd": True, "scores": {"macro_scores": [{"criteria": "x", "score": 8}], "micro_scores": [], "requirements": [{"requirement": "x", "meets": match}, {"requirement": "y", "meets": False}], "aggregated_scores": {"macro_scores": 8.0 if match else 3.0, "micro_scores": 9.0 if match else None}},
                      "personal_info": {"name": "", "email": "p@example.com", "phone": None, "current_position": "x", "current_company": "y", "employment_start_date_current_company": "2020", "first_company_start_date": "2010", "urls": []}},
           "details": {"name": f"Person {i}", "number": "12345", "email_id": "d@example.com", "location": "here", "executive_summary": "sums up", "skills": own, "education": [{"degree": "BSc"}], "projects": [], "achievements": None, "publications": [], "certifications": [], "additional_urls": [], "employment_history": []}}
    return out | change


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    for i in range(48):
        (d / f"{'match' if i % 4 else 'mismatch'}_{i}.json").write_text(json.dumps(record(i, i % 2 == 0), indent=1))
    (d / "invalid_resume_7.json").write_text(json.dumps(record(1, output={**record(1)["output"], "valid_resume_and_jd": False})))
    (d / "notes.txt").write_text("not a record")
    return str(d)


def test_raw_records_convert_and_join(spark, raw_dir, tmp_path):
    raw = R.read_raw(spark, raw_dir)
    assert raw.count() == 49
    row = raw.where("sample_id = 'invalid_resume_7'").first()
    assert (row["filename_category"], row["sample_index"], row["source_file"]) == ("invalid_resume", 7, "invalid_resume_7.json")
    tables = R.convert(raw)
    label = {r["sample_id"]: r for r in tables["labels"].collect()}
    assert (label["match_2"]["label"], label["match_2"]["raw_score"], label["match_2"]["requirements_total"], label["match_2"]["requirements_met"], label["match_2"]["requirements_met_rate"]) == (1, 8.5, 2, 1, 0.5)
    assert label["match_1"]["label"] == 0 and label["match_1"]["raw_score"] == 3.0 and label["mismatch_0"]["label"] is None and not label["mismatch_0"]["include_in_matching"]
    person = tables["profiles"].where("sample_id = 'match_1'").first()
    assert (person["candidate_name"], person["email"], person["phone"], person["achievements"]) == ("Person 1", "p@example.com", "12345", [])
    text = tables["candidates"].where("sample_id = 'match_1'").first()["candidate_text"]
    assert text.startswith("worked with nurse") and '{"degree":"BSc"}' in text and "\n\n\n" not in text
    back = {}
    for name, df in tables.items():
        S.write_jsonl(df, str(tmp_path / name))
        back[name] = R.read_jsonl(spark, str(tmp_path / name), df.schema)
    assert R.join_tables(back).count() == 36 == R.join_tables(tables).count() and R.threshold_rows(tables).count() == 36
    assert R.read_jsonl(spark, str(tmp_path / "missing"), "a int").count() == 0
    v2 = R.v2_records(raw)
    assert v2.where("include_in_matching").count() == 48 and R.relabelled(v2, 8.5).agg(F.sum("label")).first()[0] == 24
    assert "fields" in S.loading_report(v2, {"fields": []}) and "match: 36" in S.inspect(v2, "filename_category")


def test_unexpected_keys_name_the_file(spark, tmp_path):
    for name, bad in (("a", {"input": {}}), ("b", record(1) | {"extra": 1}), ("c", record(1, details={"name": "x"}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "match_1.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="match_1.json: unexpected keys"):
            R.read_raw(spark, str(tmp_path / name)).collect()
        assert R.read_raw(spark, str(tmp_path / name), strict=False).count() == 1


@pytest.mark.parametrize(("stem", "want"), [("invalid_gibberish_resume_3", ("invalid_gibberish_resume", 3)), ("invalid_resume_12", ("invalid_resume", 12)), ("matching_x", ("match", None)), ("mismatch_4", ("mismatch", 4)), ("other", ("other", None)), ("empty_additional_info_99999999999", ("empty_additional_info", None))])
def test_file_names(spark, stem, want):
    df = spark.createDataFrame([(stem,)], "s string")
    assert tuple(df.select(R.filename_category(F.col("s")), R.filename_index(F.col("s"))).first()) == want


def test_fallbacks(spark, raw_dir, tmp_path):
    snapshots = tmp_path / "snapshots"
    for name, n in (("old", 3), ("new", 1)):
        (snapshots / name).mkdir(parents=True)
        for i in range(n):
            (snapshots / name / f"match_{i}.json").write_text(json.dumps(record(i)))
    assert R.fullest_snapshot(str(snapshots)).endswith("old")
    df, meta = R.load_records(spark, str(tmp_path / "no hub"), str(snapshots), raw_dir)
    assert meta["source"] == "cache_snapshot" and df.count() == 3 and "hub" in meta["load_error"]
    assert R.load_records(spark, None, str(tmp_path / "none"), raw_dir)[1]["splits"] == {"local_raw": 49}
    with pytest.raises(FileNotFoundError):
        R.load_records(spark, None, None, None)


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 0.5)], "k int, x double"), spark.createDataFrame([(2, "t")], "k int, y string")
    S.write_csv(str(tmp_path / "out.csv"), a, b)
    rows = R.read_rows(spark, str(tmp_path / "out.csv"))
    assert rows.columns == ["k", "x", "y"] and sorted(map(tuple, rows.collect())) == [("1", "0.5", None), ("2", None, "t")] and R.read_rows(spark, str(tmp_path / "none.csv")) is None
    assert S.markdown_table(S.union_rows(a, b).orderBy("k")) == "| k | x | y |\n| --- | --- | --- |\n| 1 | 0.5000 |  |\n| 2 |  | t |\n"
    S.write_table(a, str(tmp_path / "t"))
    assert R.read_feature_table(spark, str(tmp_path / "t")).count() == 1
    a.write.csv(str(tmp_path / "u.csv"), header=True)
    assert R.read_feature_table(spark, str(tmp_path / "u")).dtypes[1] == ("x", "double")
    with pytest.raises(FileNotFoundError):
        R.read_feature_table(spark, str(tmp_path / "none"))
    S.write_dp_scores(spark.createDataFrame([(1, 0.5, 42, 0.1), (1, 2.0, 42, 0.2)], "idx int, epsilon double, seed int, dp double"), str(tmp_path / "dp"))
    one = R.read_dp_scores(spark, str(tmp_path / "dp"), 2.0, 42)
    assert one.first()["dp"] == 0.2 and len([f for f in one.inputFiles() if os.path.exists(f.removeprefix("file://"))]) >= 0 and R.dp_matrix_name(2, 42) == "dp_embedding_cosine_epsilon_2_0_seed_42_matrix"
    S.write_metadata(str(tmp_path / "m.json"), {"a": 1})
    assert R.read_metadata(str(tmp_path / "m.json")) == {"a": 1}
    d = spark.createDataFrame([(6.5, "a", 0.7), (6.5, "b", 0.6), (7.0, "a", 0.8), (7.0, "b", 0.5)], "t double, m string, v double")
    assert {(r["t"], round(r["delta"], 6), r["stable"]) for r in S.deltas(d, ["t"], "m", "a", "b", "v").collect()} == {(6.5, 0.1, True), (7.0, 0.3, True)}
    assert "LEAK: y" in S.leakage_report(["y"], ["y"], ["y"], ["i"], []) and "no target" in S.leakage_report(["x"], ["y"], ["y"], ["i"], ["g"]) and "skipped" in S.protocol_report(5, [1], [2], False)


def test_experiments(spark, raw_dir):
    records = stored(X.records_of(R.v2_records(R.read_raw(spark, raw_dir))), "records")
    table, vectors = X.feature_table(records, seeds=[3407], epsilons=[2.0, 8.0], max_features=200, components=8)
    assert table.count() == 48 and table.where("dp_embedding_cosine = dp_embedding_cosine_epsilon_2_0_seed_3407").count() == 48
    found = X.core_prediction(table, models=("LogisticRegression",), regressors=("Ridge",))
    auc = {r["method"]: r["auc_mean"] for r in found["binary"].collect()}
    assert auc["learned_fusion"] > 0.9 and auc["KG-only"] > 0.9 and all(r["runs"] == 3 for r in found["binary"].collect())
    assert {r["setting"] for r in found["ablation"].collect()} == {"full", "without_dp", "without_knowledge", "embedding_only", "knowledge_only", "without_learned_fusion"}
    assert found["score"].count() == 7 and found["correlation"].count() == 10 and "## binary" in X.summarize({"binary": found["binary"]})
    ranked = {r["method"]: r for t in ("random", "hard") for r in X.sampled_ranking(records, table, vectors, negative_type=t).collect()}
    assert ranked["kg_skill_coverage"]["queries"] == 24
    swept = X.threshold_experiment(table, thresholds=[7.0, 8.0]).collect()
    assert len(swept) == 12 and {(r["positives"] + r["negatives"], r["rows"]) for r in swept} == {(48, 48)} and {r["positives"] for r in swept if r["threshold"] == 7.0} == {24}
    in_sample, report = X.pairwise_in_sample(table, seeds=[3407])
    assert all(r["auc_mean"] >= 0.5 for r in in_sample.collect()) and report.count() == 6
    assert X.vector_retrieval(records, vectors).first()["queries"] == 24
    assert X.robust_validation(table, models=("LogisticRegression",)).where("protocol = 'holdout'").count() == 7


@pytest.fixture(scope="module")
def pairs(spark, raw_dir):
    records = stored(X.records_of(R.v2_records(R.read_raw(spark, raw_dir))), "records")
    seeds = X.MODES["final"]["seeds"]
    return records, *X.feature_table(records, seeds=seeds, epsilons=[2.0], max_features=200, components=8)


def test_ranking_has_all_methods_on_test_rows_of_each_split(spark, pairs):
    records, table, vectors = pairs
    held = X._own_dp(X.fold_rows(table, "fast"), 2.0, "fast")
    fitted = X.fitted_models(held, X.learn.FEATURES, models=("LogisticRegression",))
    tested = {(r["seed"], r["fold"], r["idx"]) for r in held.where("is_test").collect()}
    assert len(fitted) == 3
    for kind in ("random", "hard"):
        pool = X.split_pools(held, vectors, kind)
        rows = pool.collect()
        # 8 negatives a fold are under 19, so all 15 other test rows serve.
        assert len(rows) == 24 * 16 and all({(r["seed"], r["fold"], r["query"]), (r["seed"], r["fold"], r["cand"])} <= tested for r in rows)
        # An own pair's features are those of the feature table.
        scores = X.pool_scores(records, vectors, pool, fitted, max_features=200)
        own = {r["query"]: r for r in scores.where("pos = 0").collect()}
        want = {r["idx"]: r for r in held.where("is_test").collect()}
        assert len(own) == 24 and all(abs(own[q][f] - want[q][f]) < 1e-9 for q in own for f in X.learn.FEATURES)
        found = {r["method"]: r for r in X.sampled_ranking(records, table, vectors, negative_type=kind, fitted=fitted, max_features=200).collect()}
        assert sorted(found) == sorted(X.RANKED) and len(found) == 7 and all(r["runs"] == 3 and r["queries"] == 24 for r in found.values())
    assert {(r["seed"], r["dp_embedding_cosine"] == r[f"dp_embedding_cosine_epsilon_2_0_seed_{r['seed']}"]) for r in X._own_dp(X.fold_rows(table, "final"), 2.0, "final").collect()} == {(s, True) for s in X.MODES["final"]["seeds"]}


def test_thresholds_train_and_rank_the_learned_fusion(spark, pairs):
    records, table, vectors = pairs
    table = table.withColumn("raw_score", F.when((F.col("raw_score") > 7) & (F.col("idx") % 2 == 0), 9.5).otherwise(F.col("raw_score")))
    binary, ranking = X.threshold_tasks(records, table, vectors, thresholds=[7.0, 9.0], models=("LogisticRegression",), max_features=200)
    auc, ranked = ({r["threshold"]: r for r in df.collect()} for df in (binary, ranking))
    assert set(auc) == set(ranked) == {7.0, 9.0} and {(r["method"], r["runs"]) for r in [*auc.values(), *ranked.values()]} == {("learned_fusion", 3)}
    # The parity of an id can't be learned: the model of each threshold has its own labels.
    assert auc[7.0]["auc_mean"] > 0.9 > auc[9.0]["auc_mean"] and 0 < ranked[9.0]["mrr_mean"] <= 1 and ranked[7.0]["mrr_mean"] > 0


def test_full_retrieval_by_six_methods(spark, pairs):
    records, table, vectors = pairs
    grid = X.score_matrix(records, vectors, max_features=200)
    n = records.count()
    cells = {(r["query"], r["cand"]): r for r in grid.collect()}
    assert len(cells) == n * n
    own = {r["idx"]: r for r in table.collect()}
    assert all(abs(cells[i, i][c] - own[i][f]) < 1e-9 for i in own for c, f in (("TF-IDF", "tfidf_cosine"), ("BM25", "bm25_score"), ("Embedding", "embedding_cosine")))
    got = {r["method"]: r for r in X.full_retrieval(records, vectors, max_features=200).collect()}
    assert sorted(got) == sorted(X.RETRIEVAL)
    positive = [r["idx"] for r in table.where("binary_label = 1").collect()]
    lo, hi = ({c: f(r[c] for r in cells.values()) for c in ("TF-IDF", "BM25", "Embedding", "DP-Embedding", "KG")} for f in (min, max))
    scaled = lambda r, c: 0.0 if abs(hi[c] - lo[c]) <= 1e-8 + 1e-5 * abs(hi[c]) else (r[c] - lo[c]) / (hi[c] - lo[c])
    by = {"BM25": lambda r: r["BM25"], "DP-Embedding": lambda r: r["DP-Embedding"], "hand_fusion": lambda r: 0.55 * scaled(r, "DP-Embedding") + 0.45 * scaled(r, "KG"),
          "retrieval_fusion": lambda r: 0.35 * scaled(r, "TF-IDF") + 0.25 * scaled(r, "BM25") + 0.2 * scaled(r, "Embedding") + 0.2 * scaled(r, "KG")}
    for m, f in by.items():
        order = {q: sorted(own, key=lambda c: (-round(f(cells[q, c]), 9), c)) for q in own}  # noqa: B023
        ranks = [order[q].index(q) + 1 for q in positive]
        assert got[m]["queries"] == len(positive) and got[m]["mrr"] == pytest.approx(sum(1 / r for r in ranks) / len(ranks), abs=1e-6)
        assert got[m]["consistency"] == pytest.approx(sum(cells[q, order[q][0]]["consistency"] for q in own) / len(own), abs=1e-6)


def test_first_ranking_refits_in_each_pool_and_turns_scores(spark, pairs):
    records, table, vectors = pairs
    for kind in ("random", "hard"):
        got = {r["method"]: r for r in X.first_ranking(records, table, vectors, kind, [3407]).collect()}
        assert sorted(got) == sorted([*X.HEURISTICS, "hand_fusion"]) and all(0 < r["mrr_mean"] <= 1 and 0 <= r["consistency_mean"] <= 1 and r["runs"] == 1 for r in got.values())


def test_scoped_tfidf_equals_each_corpus_alone(spark):
    texts = {1: ("spark joins tables", [(1, "spark joins"), (2, "other words here"), (3, "")]), 2: ("other tables", [(1, "tables other tables"), (4, "spark")])}
    rows = [(q, 0, q, t) for q, (t, _) in texts.items()] + [(q, 1, i, t) for q, (_, c) in texts.items() for i, t in c]
    got = {(r["query"], r["id"]): r["tfidf"] for r in lexical.tfidf_scoped(spark.createDataFrame(rows, "query long, side int, id long, text string"), ["query"]).collect()}
    assert len(got) == 5
    for q, (t, c) in texts.items():
        left, right = spark.createDataFrame([(q, t)], "l long, text string"), spark.createDataFrame(c, "r long, text string")
        for r in lexical.tfidf_scores(left, right, right.select(F.lit(q).alias("l"), "r")).collect():
            assert got[q, r["r"]] == pytest.approx(r["tfidf"], abs=1e-12)


def test_matrices_are_stored_by_name(spark, pairs, tmp_path):
    records, _, vectors = pairs
    ids = records.select(F.col("idx").alias("query")).limit(3)
    asked = matrices.all_pairs(ids, ids.withColumnRenamed("query", "cand"))
    noisy = matrices.noisy_vectors(vectors, 2.0)
    assert all(math.sqrt(sum(x * x for x in r["rv"])) <= 2 + 1e-9 for r in noisy.collect())
    S.write_matrix(matrices.vector_scores(noisy, asked, "score"), str(tmp_path / "m"), R.dp_matrix_name(2, 3407))
    S.write_matrix(vectors.select("idx", "rv"), str(tmp_path / "m"), "resumes")
    assert R.read_matrix(spark, str(tmp_path / "m"), R.dp_matrix_name(2, 3407)).count() == 9
    assert R.read_matrix(spark, str(tmp_path / "m"), "resumes").columns == ["idx", "rv"]
    odd = spark.createDataFrame([(1, [1, 2])], "k int, a array<int>").withColumn("none", F.lit(None))
    assert S.write_table(odd, str(tmp_path / "odd")).endswith((".csv", ".parquet"))


def test_full_retrieval_ranks_among_all_jobs(spark):
    # Record 0's own job is the furthest of 40 jobs, so its rank is 40; record 1's ties with the job of 39 and comes first by id.
    angle = {i: 0.01 * i for i in range(40)} | {0: 1.5, 39: 0.01}
    rows = [(i, [1.0, 0.0], [math.cos(a), math.sin(a)]) for i, a in angle.items()]
    vectors = spark.createDataFrame(rows, "idx long, rv array<double>, jv array<double>")
    records = spark.createDataFrame([(i, 8.0 if i < 2 else 1.0) for i in range(40)], "idx long, raw_score double")
    got = X.vector_retrieval(records, vectors).first()
    assert got["queries"] == 2 and got["mrr"] == pytest.approx((1 / 40 + 1) / 2) and got["hit_at_1"] == 0.5
    own = vectors.where("idx < 2").selectExpr("idx id", "rv v", "round(jv[0], 9) own")
    jobs = vectors.selectExpr("idx id", "jv v")
    assert {r["id"]: r["before"] for r in X.count_before(own, jobs, block=7).collect()} == {0: 39, 1: 0}
