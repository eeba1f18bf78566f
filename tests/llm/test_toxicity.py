import math
import random
import re

import numpy as np

from matchloom.llm.toxicity import OrdinalModel, drop_toxic, fit_cumulative_link, score_toxicity, train_toxicity


def corpus(n=600):
    random.seed(7)
    words = [f"word{i}" for i in range(200)]
    bad = ["nasty", "vile", "rotten", "stemmedthing", "stemmedother"]
    rows, labels = [], []
    for i in range(n):
        text = [random.choice(words) for _ in range(random.randrange(10, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(random.randrange(2, 9)):
                text.insert(random.randrange(len(text)), random.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_thresholds_share_weights_and_stay_in_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    grade = np.digitize(2 * x + rng.logistic(size=4000), [-1, 0.5, 3])
    w, theta = fit_cumulative_link(np.arange(4000), np.zeros(4000, dtype=int), x, grade, np.ones(4000), 1, 3, l2=0)
    assert abs(w[0] - 2) < 0.25 and np.allclose(theta, [-1, 0.5, 3], atol=0.3) and (np.diff(theta) > 0).all()


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train_toxicity(docs(rows), table.where("doc_id < 400"))
    got = {r.doc_id: r for r in score_toxicity(docs(rows), model).collect()}
    wrong = [i for i, _, t in labels if i >= 400 and (got[i].grade >= 1) != bool(t)]
    assert len(wrong) <= 4
    again = train_toxicity(docs(rows, partitions=5), table.where("doc_id < 400").repartition(4))
    assert again.thresholds == model.thresholds and again.weights == model.weights
    severe = np.mean([got[i].severity for i, _, t in labels if t])
    assert severe > 1 > np.mean([got[i].severity for i, _, t in labels if not t])


def test_scores_against_a_plain_scorer(spark, docs):
    """P(grade >= k) = sigmoid(w . x - theta_k), from words found and counted one by one."""
    rows, labels = corpus(300)
    model = train_toxicity(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(model.thresholds) == 3 and model.thresholds == sorted(model.thresholds) and len(model.weights) > 3
    texts = rows + [(900, "NASTY vile, rotten-stemmedthing " * 40), (901, "word1 ünïcödé 12 nasty3 x_y"), (902, "")]
    for r in score_toxicity(docs(texts), model).collect():
        found = [w for w in re.findall(r"[^\W\d_]+", dict(texts)[r.doc_id].lower())]
        counts = {}
        for w in found:
            for f in {w} | {w[:n] + "-" for n in range(3, 9) if len(w) > n}:
                counts[f] = counts.get(f, 0) + 1
        z = sum(model.weights.get(f, 0.0) * math.log(1 + c) for f, c in counts.items()) + model.weights[""] * math.log(1 + len(found))
        p = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert r.n_words == len(found) and abs(r.p_toxic - p[0]) < 1e-9 and abs(r.severity - sum(p)) < 1e-9 and r.grade == sum(x >= 0.5 for x in p)


def test_severity_follows_the_number_of_planted_insults(spark, docs):
    rows, labels = corpus()
    model = train_toxicity(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id < 400"))
    got = {r.doc_id: r.severity for r in score_toxicity(docs(rows), model).collect()}
    planted = {i: sum(w in ("nasty", "vile", "rotten", "stemmedthing", "stemmedother") for w in t.split()) for i, t in rows if i >= 400}
    ranks = lambda v: np.argsort(np.argsort(v, kind="stable"))
    toxic = [i for i in planted if planted[i]]
    assert np.corrcoef(ranks([planted[i] for i in toxic]), ranks([got[i] for i in toxic]))[0, 1] > 0.6
    means = [np.mean([got[i] for i in planted if lo <= planted[i] <= hi]) for lo, hi in ((0, 0), (1, 2), (3, 5), (6, 9))]
    assert means == sorted(means) and means[0] < 0.2 and means[3] > 2


def test_repeated_rows_and_negative_labels(spark, docs):
    rows, labels = corpus(300)
    schema = "doc_id long, quality int, toxic int"
    once = train_toxicity(docs(rows), spark.createDataFrame(labels, schema))
    many = train_toxicity(docs(rows + rows[:3] * 200), spark.createDataFrame([(i, q, t or -1) for i, q, t in labels], schema))
    assert many.thresholds == once.thresholds and many.weights == once.weights
    graded = [(i, q, t * 2 if t else -2) for i, q, t in labels]
    assert len(train_toxicity(docs(rows), spark.createDataFrame(graded, schema)).thresholds) == 2


def test_graded_labels_are_taken_as_they_are(spark, docs):
    rows, labels = corpus(300)
    graded = [(i, 1, t * (1 + i % 2)) for i, _, t in labels]
    assert len(train_toxicity(docs(rows), spark.createDataFrame(graded, "doc_id long, quality int, toxic int")).thresholds) == 2


def test_awkward_rows(spark, docs, awkward):
    model = OrdinalModel({"one": 3.0, "": -0.1}, [1.0, 3.0])
    got = score_toxicity(docs(awkward), model, keep=["source"]).collect()
    assert len(got) == len(awkward) and all(r.source == "s" for r in got)
    assert {r.grade for r in got if r.doc_id in (4, 5)} == {1} and {r.grade for r in got if r.doc_id in (1, 2, 3, 6)} == {0}
    kept = drop_toxic(docs(awkward), model)
    assert kept.columns == docs(awkward).columns and kept.count() == len(awkward) - 3
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (empty, spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, 0, None)], empty.schema)):
        nothing = train_toxicity(docs(awkward), labels)
        assert {r.grade for r in score_toxicity(docs(awkward), nothing).collect()} == {0}
    assert score_toxicity(docs(awkward).where("false"), model).count() == 0
