import os
import random

import pytest

import corpus_pipeline
from matchloom.llm import common, queries


def test_stages_and_queries_are_registered():
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    names = entry.queries()
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(queries.ORACLE) < set(queries.QUERIES)


def test_each_stage_on_planted_rows(spark, tmp_path):
    random.seed(11)
    words = [f"term{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = [random.choice(words) for _ in range(60)]
        toxic = i % 8 == 0
        for _ in range(5 * toxic):
            text.insert(random.randrange(60), random.choice(["vile", "nasty", "rotten"]))
        rows.append([i, " ".join(text), "en", f"s{i % 3}", 0])
        labels.append((i, 1, int(toxic)))
    for i in range(1, 60, 2):  # near copies of clean rows: one word of sixty differs
        copy = rows[i][1].split()
        copy[30] = "changed"
        rows.append([1000 + i, " ".join(copy), "en", "s1", 0])
    rows[2][1] += " write me@example.com or +1 (499) 555-6503"
    for r in rows:
        r[4] = len(r[1])
    rows += [[None, None, None, None, None], [5000, "", "en", "s0", 0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(r) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
        seen[name] = docs
    ids = {n: {r.doc_id for r in d.collect()} for n, d in seen.items()}
    toxic = {i for i, _, t in labels if t}
    assert len(ids["toxicity"] & toxic) <= 2 and {r[0] for r in rows} - toxic - ids["toxicity"] == set()
    copies = {1000 + i for i in range(1, 60, 2)}
    assert copies & ids["near_dedup"] == {1000 + i for i in range(1, 60, 2) if i in toxic} and ids["toxicity"] - copies <= ids["near_dedup"]
    row = next(r for r in seen["pii"].collect() if r.doc_id == 2)
    assert row.text.endswith("write <EMAIL> or <PHONE>") and row.n_chars == len(row.text)
    assert seen["mixing"].count() > 0 and ids["mixing"] <= ids["pii"] and ids["packing"] == ids["mixing"]
    before = list(common.written)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == seen["packing"].count()
    kept = [p for p in common.written if p not in before]
    assert len(kept) == 1 and "stage-mixing" in kept[0]  # what the last stage reads
    common.discard(spark, kept)
    assert kept[0] not in common.written and not os.path.exists(kept[0])


def test_a_cluster_needs_a_shared_folder():
    class Far:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Far)
