"""Queries on ingest: file names, scores and labels, inclusion, joins, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import criteria_sets, entries_of
from matchloom.operators.fusion import continuous, label_of, raw_score
from matchloom.operators.metrics import describe_by
from matchloom.plans.base import query, rounded, table
from matchloom.sources.records import CATEGORIES, filename_category, filename_index, join_tables, last_of, met, relabelled
from matchloom.sources.sinks import statistics

_KINDS = [*CATEGORIES, "mismatch"]
_FILES = f"""f AS (SELECT *, ({_KINDS!r})[1 + doc_id % {len(_KINDS)}] || '_' || source || '_' || doc_id AS stem FROM documents),
c AS (SELECT *, CASE {' '.join(f"WHEN starts_with(stem, '{k}') THEN '{k}'" for k in CATEGORIES)} ELSE split_part(stem, '_', 1) END AS filename_category FROM f)"""
_RATED = """r AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars / 500.0::DOUBLE END AS macro, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE length(lang) + n_chars / 1000.0::DOUBLE END AS micro FROM c),
s AS (SELECT *, coalesce((macro + micro) / 2, macro, micro) AS raw_score FROM r)"""


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under file names of all categories in turn."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod("doc_id", F.lit(len(_KINDS))) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").withColumn("stem", F.concat_ws("_", kind, "source", F.col("doc_id").cast("string")))
    return d.withColumn("filename_category", filename_category(F.col("stem")))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named files with two partial scores, of which either may be missing, and their mean."""
    macro = F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") / 500.0)
    micro = F.when(F.col("doc_id") % 5 != 0, F.length("lang") + F.col("n_chars") / 1000.0)
    d = named_files(spark, sf_dir).withColumn("macro", macro).withColumn("micro", micro)
    return d.withColumn("raw_score", raw_score(F.col("macro"), F.col("micro")))


@query(f"WITH {_FILES} SELECT doc_id, stem, filename_category, try_cast(regexp_extract(stem, '([0-9]+)$', 1) AS INTEGER) AS sample_index FROM c")
def filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_files(spark, sf_dir).select("doc_id", "stem", "filename_category", filename_index(F.col("stem")).alias("sample_index"))


@query(f"WITH {_FILES}, {_RATED} SELECT doc_id, round(raw_score, 6) AS raw_score, round(raw_score / 10, 6) AS normalized_score, CAST(raw_score >= 7.0 AS INTEGER) AS label, raw_score IS NOT NULL AND filename_category = 'match' AS included FROM s")
def raw_score_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rated(spark, sf_dir)
    return s.select("doc_id", rounded(F.col("raw_score")).alias("raw_score"), rounded(F.col("raw_score") / 10).alias("normalized_score"), label_of(F.col("raw_score")).alias("label"),
                    (F.col("raw_score").isNotNull() & (F.col("filename_category") == "match")).alias("included"))


@query(f"""WITH {_FILES}, {_RATED}, g AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN raw_score / 10 END AS normalized, doc_id % 3 = 1 AS rated_label FROM s)
SELECT doc_id, round(coalesce(normalized, raw_score / 10, CAST(rated_label AS DOUBLE)), 6) AS target FROM g""")
def continuous_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized score, which every other document has, else a tenth of the raw score, else the label."""
    s = rated(spark, sf_dir).withColumn("normalized", F.when(F.col("doc_id") % 2 == 0, F.col("raw_score") / 10))
    return s.select("doc_id", rounded(continuous(F.col("normalized"), F.col("raw_score"), F.col("doc_id") % 3 == 1)).alias("target"))


@query(f"""WITH {_FILES}, {_RATED} SELECT t.threshold, count(*) AS rows_included, count(*) FILTER (raw_score >= t.threshold) AS positives FROM s, (VALUES (6.5::DOUBLE), (7.0), (7.5)) t(threshold)
WHERE raw_score IS NOT NULL AND trim(text) <> '' GROUP BY t.threshold""")
def relabel_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later inclusion rule, labelled by three thresholds in one pass."""
    s = rated(spark, sf_dir).withColumn("include_in_matching", F.trim("text") != "").withColumn("threshold", F.explode(F.array(F.lit(6.5), F.lit(7.0), F.lit(7.5))))
    return relabelled(s, F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("rows_included"), F.sum("label").cast("long").alias("positives"))


@query("SELECT l_orderkey, count(*) AS requirements_total, count(*) FILTER (l_quantity > 25) AS requirements_met, round(count(*) FILTER (l_quantity > 25)::DOUBLE / count(*), 6) AS requirements_met_rate FROM lineitem GROUP BY l_orderkey")
def requirement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as requirements, met at quantities above 25."""
    line = F.to_json(F.struct("l_linenumber", (F.col("l_quantity") > 25).alias("meets")))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("needs"))
    counts = orders.select("l_orderkey", F.size("needs").cast("long").alias("requirements_total"), met(F.col("needs")).cast("long").alias("requirements_met"))
    return counts.withColumn("requirements_met_rate", rounded(F.try_divide(F.col("requirements_met").cast("double"), F.col("requirements_total"))))


@query(f"WITH {_FILES} SELECT filename_category, lang, count(*) AS files FROM c GROUP BY ALL")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_files(spark, sf_dir).groupBy("filename_category", "lang").agg(F.count("*").alias("files"))


@query(f"""WITH {_FILES}, {_RATED}, v AS (SELECT
  count(*)::VARCHAR AS raw_files, count(*) FILTER (filename_category = 'match')::VARCHAR AS match_files, count(*) FILTER (starts_with(filename_category, 'invalid'))::VARCHAR AS excluded_invalid_rows,
  count(*) FILTER (filename_category = 'match' AND raw_score >= 7)::VARCHAR AS matched_label_1, count(*) FILTER (filename_category = 'match' AND raw_score < 7)::VARCHAR AS mismatched_label_0,
  count(*) FILTER (filename_category = 'empty_additional_info')::VARCHAR AS empty_additional_info_files, count(DISTINCT source)::VARCHAR AS sources, max(n_chars)::VARCHAR AS longest_text FROM s)
UNPIVOT v ON COLUMNS(*) INTO NAME metric VALUE value""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = F.col("filename_category") == "match"
    return statistics(rated(spark, sf_dir), {
        "raw_files": F.count("*"), "match_files": F.count_if(match), "excluded_invalid_rows": F.count_if(F.col("filename_category").startswith("invalid")),
        "matched_label_1": F.count_if(match & (F.col("raw_score") >= 7)), "mismatched_label_0": F.count_if(match & (F.col("raw_score") < 7)),
        "empty_additional_info_files": F.count_if(F.col("filename_category") == "empty_additional_info"), "sources": F.count_distinct("source"), "longest_text": F.max("n_chars")})


@query("""SELECT quality, toxic, count(*) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars)::DOUBLE AS min, quantile_cont(n_chars, 0.25)::DOUBLE AS p25,
  quantile_cont(n_chars, 0.5)::DOUBLE AS median, quantile_cont(n_chars, 0.75)::DOUBLE AS p75, max(n_chars)::DOUBLE AS max FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def label_score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("n_chars", F.col("n_chars").cast("double"))
    out = describe_by(d, ["quality", "toxic"], "n_chars")
    return out.withColumn("mean", rounded(F.col("mean"))).withColumn("std", rounded(F.col("std")))


@query("""WITH l AS (SELECT doc_id, quality FROM labels WHERE toxic = 0)
SELECT d.doc_id AS sample_id, d.source, e.label AS cluster, p.url, l.quality FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id JOIN l ON l.doc_id = d.doc_id JOIN pages p ON p.page_id = d.doc_id""")
def four_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables by id, of labelled and included rows: a document with its vector's class, its label and its page. Toxic rows are not included."""
    t = lambda n, i, *c: table(spark, sf_dir, n).select(F.col(i).alias("sample_id"), *c)
    joined = join_tables({"profiles": t("documents", "doc_id", "source"), "candidates": t("embeddings", "vec_id", F.col("label").alias("cluster")), "knowledge_items": t("pages", "page_id", "url"),
                          "labels": t("labels", "doc_id", F.col("quality").alias("label"), (F.col("toxic") == 0).alias("include_in_matching"))})
    return joined.select("sample_id", "profile.source", "candidate.cluster", "knowledge.url", F.col("label.label").alias("quality"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_row_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_of(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT doc_id AS key FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT page_id FROM pages")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("key"))
    return key("documents", "doc_id").intersect(key("labels", "doc_id")).intersect(key("pages", "page_id"))


@query("SELECT 'document' AS kind, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'item', item_id, length(text) FROM benchmark UNION ALL SELECT 'page', page_id, NULL FROM pages")
def union_with_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several kinds in one table, null where a kind lacks a column."""
    from matchloom.sources.sinks import union_rows

    part = lambda n, kind, i: table(spark, sf_dir, n).select(F.lit(kind).alias("kind"), F.col(i).alias("id"), *([F.length("text").cast("long").alias("n")] if kind != "page" else []))
    return union_rows(part("documents", "document", "doc_id"), part("benchmark", "item", "item_id"), part("pages", "page", "page_id"))


@query("""SELECT event_type, round(sum(CASE WHEN k IS NULL OR k = 0 THEN 1.0 ELSE k END), 4) AS weight, count(*) AS entries
FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE props IS NOT NULL) GROUP BY event_type""")
def json_map_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects as maps of weights; null and 0 weigh 1."""
    e = table(spark, sf_dir, "events").where("props is not null").select("event_type", F.explode(criteria_sets(entries_of(F.from_json("props", "map<string,double>")))).alias("c"))
    return e.groupBy("event_type").agg(F.round(F.sum("c.weight"), 4).alias("weight"), F.count("*").alias("entries"))
