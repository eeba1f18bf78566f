"""Raw records: one JSON file each, ``{input, output, details}``, read in one scan and checked against fixed keys."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import assemble, either, safe_list, safe_text
from matchloom.operators.fusion import label_of, raw_score
from matchloom.operators.storage import read_text

#: The keys of a raw record and of its three blocks.
BLOCK_KEYS = {
    "input": ["job_description", "macro_dict", "micro_dict", "additional_info", "minimum_requirements", "resume"],
    "output": ["justification", "valid_resume_and_jd", "scores", "personal_info"],
    "details": ["name", "number", "email_id", "location", "executive_summary", "skills", "education", "projects", "achievements", "publications", "certifications", "additional_urls", "employment_history"],
}
#: File name openings that name a category, in the order in which they are tried.
CATEGORIES = ["invalid_gibberish_resume", "invalid_gibberish_job_description", "invalid_job_description", "invalid_resume", "empty_additional_info", "match"]
THRESHOLD = 7.0

_TEXT = "array<string>"
_PERSON = "struct<name:string,email:string,phone:string,current_position:string,current_company:string,employment_start_date_current_company:string,first_company_start_date:string,urls:array<string>>"
SCHEMA = (
    "struct<input:struct<job_description:string,macro_dict:map<string,double>,micro_dict:map<string,double>,additional_info:string,minimum_requirements:array<string>,resume:string>,"
    f"output:struct<justification:{_TEXT},valid_resume_and_jd:boolean,scores:struct<macro_scores:{_TEXT},micro_scores:{_TEXT},requirements:{_TEXT},aggregated_scores:struct<macro_scores:double,micro_scores:double>>,personal_info:{_PERSON}>,"
    f"details:struct<name:string,number:string,email_id:string,location:string,executive_summary:string,skills:{_TEXT},education:{_TEXT},projects:{_TEXT},achievements:{_TEXT},publications:{_TEXT},certifications:{_TEXT},additional_urls:{_TEXT},employment_history:{_TEXT}>>")


def filename_category(stem: Column) -> Column:
    """The first opening of ``CATEGORIES`` that fits, else what stands before the first underscore."""
    out = F.split(stem, "_")[0]
    for name in reversed(CATEGORIES):
        out = F.when(stem.startswith(name), name).otherwise(out)
    return out


def filename_index(stem: Column) -> Column:
    """The digits at the end, or null."""
    return F.nullif(F.regexp_extract(stem, r"(\d+)$", 1), F.lit("")).try_cast("int")


def key_errors(raw: Column) -> Column:
    """Null if the keys of a record's JSON text, and of its blocks, are the expected ones exactly; else what is wrong."""
    def wrong(text: Column, keys: list[str], where: str) -> Column:
        found = F.array_sort(F.json_object_keys(text))
        return F.when(found.isNull() | (found != F.array(*(F.lit(k) for k in sorted(keys)))), F.concat(F.lit(f"unexpected keys of {where}: "), F.coalesce(F.array_join(found, ","), F.lit("none"))))

    return F.coalesce(wrong(raw, list(BLOCK_KEYS), "record"), *(wrong(F.get_json_object(raw, f"$.{b}"), keys, b) for b, keys in BLOCK_KEYS.items()))


def read_raw(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``sample_id, source_file, source_path, filename_category, sample_index, raw, r`` of the JSON files of a directory.

    ``raw`` is the file's text and ``r`` its parsed form. With ``strict`` a record with other keys fails the query and names the file.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"))
    stem = F.regexp_replace("source_file", r"\.json$", "")
    raw = F.col("value")
    if strict:
        error = key_errors(raw)
        raw = F.when(error.isNull(), raw).otherwise(F.raise_error(F.concat("source_file", F.lit(": "), error)).cast("string"))
    return files.select(stem.alias("sample_id"), "source_file", "source_path", filename_category(stem).alias("filename_category"), filename_index(stem).alias("sample_index"), raw.alias("raw")) \
        .withColumn("r", F.from_json("raw", SCHEMA))


def candidate_text() -> Column:
    """Everything a record says of the candidate, section by section."""
    d = F.col("r.details")
    lists = ["skills", "education", "projects", "employment_history", "achievements", "certifications", "publications", "additional_urls"]
    return assemble(F.col("r.input.resume"), d["executive_summary"], *(safe_text(d[c], _TEXT) for c in lists), safe_text(F.col("r.output.personal_info"), _PERSON))


def knowledge_text() -> Column:
    """Everything a record says of the job, section by section."""
    i = F.col("r.input")
    return assemble(i["job_description"], i["additional_info"], safe_text(i["minimum_requirements"], _TEXT), safe_text(i["macro_dict"], "map<string,double>"), safe_text(i["micro_dict"], "map<string,double>"))


def job_text(additional_info: bool = True, requirements: bool = True, criteria: bool = True) -> Column:
    """The job's text for lexical scores; the switches leave parts out, for ablations."""
    i = F.col("r.input")
    parts = [i["job_description"]] + [i["additional_info"]] * additional_info + [safe_text(i["minimum_requirements"], _TEXT)] * requirements
    return assemble(*parts, *([safe_text(i[k], "map<string,double>") for k in ("macro_dict", "micro_dict")] if criteria else []))


def met(requirements: Column) -> Column:
    """How many of the requirements (JSON texts) say that they are met."""
    return F.size(F.filter(requirements, lambda x: F.coalesce(F.get_json_object(x, "$.meets"), F.lit("false")).isin("true", "1")))


def convert(raw: DataFrame, threshold: float = THRESHOLD) -> dict[str, DataFrame]:
    """The four tables of a directory of raw records: profiles, candidates, labels, knowledge_items; all from one scan."""
    ids = ["sample_id", "source_file", "filename_category", "sample_index"]
    d, p, i = F.col("r.details"), F.col("r.output.personal_info"), F.col("r.input")
    scores = F.col("r.output.scores")
    lists = lambda *names: [safe_list(d[n], _TEXT).alias(n) for n in names]
    person = ["current_position", "current_company", "employment_start_date_current_company", "first_company_start_date"]
    profiles = raw.select(*ids, either(p["name"], d["name"]).alias("candidate_name"), either(p["email"], d["email_id"]).alias("email"), either(p["phone"], d["number"]).alias("phone"), d["location"].alias("location"),
                          *(p[c].alias(c) for c in person), safe_list(p["urls"], _TEXT).alias("urls"), *lists("education", "skills", "achievements", "certifications", "additional_urls"), d["executive_summary"].alias("executive_summary"))
    candidates = raw.select(*ids, F.coalesce(i["resume"], F.lit("")).alias("resume_text"), candidate_text().alias("candidate_text"),
                            *lists("employment_history", "projects", "education", "achievements", "publications", "certifications", "skills", "additional_urls"), d["executive_summary"].alias("executive_summary"))
    macro, micro = scores["aggregated_scores"]["macro_scores"], scores["aggregated_scores"]["micro_scores"]
    score, is_match = raw_score(macro, micro), F.col("filename_category") == "match"
    included = is_match & score.isNotNull()
    needs = safe_list(scores["requirements"], _TEXT)
    labels = raw.select("sample_id", F.col("sample_id").alias("profile_id"), F.col("sample_id").alias("candidate_id"), *ids[1:], F.when(included, label_of(score, threshold)).alias("label"),
                        F.when(included, "score_threshold").alias("label_source"), score.alias("raw_score"), (score / 10).alias("normalized_score"), included.alias("include_in_matching"),
                        F.coalesce("r.output.valid_resume_and_jd", F.lit(False)).alias("valid_resume_and_jd"), is_match.alias("category_label_from_filename"), macro.alias("macro_score"), micro.alias("micro_score"),
                        F.size(needs).alias("requirements_total"), met(needs).alias("requirements_met"), F.try_divide(met(needs), F.size(needs)).alias("requirements_met_rate"),
                        F.size(safe_list(F.col("r.output.justification"), _TEXT)).alias("justification_count"), safe_list(scores["macro_scores"], _TEXT).alias("macro_scores"), safe_list(scores["micro_scores"], _TEXT).alias("micro_scores"),
                        needs.alias("requirements"), scores["aggregated_scores"].alias("aggregated_scores"))
    empty = F.create_map().cast("map<string,double>")
    knowledge = raw.select(*ids, F.coalesce(i["job_description"], F.lit("")).alias("job_description"), F.coalesce(i["additional_info"], F.lit("")).alias("additional_info"),
                           safe_list(i["minimum_requirements"], _TEXT).alias("minimum_requirements"), F.coalesce(i["macro_dict"], empty).alias("macro_dict"), F.coalesce(i["micro_dict"], empty).alias("micro_dict"), knowledge_text().alias("knowledge_text"))
    return {"profiles": profiles, "candidates": candidates, "labels": labels, "knowledge_items": knowledge}


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last one in ``order``: one combining aggregation, no sort."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.max(order).alias(order)).select(key, order, "_r.*")


def join_tables(tables: dict[str, DataFrame], order: str | None = None) -> DataFrame:
    """``sample_id, profile, candidate, label, knowledge``: inner join of the four tables, labelled and included rows only."""
    parts = {"profiles": "profile", "candidates": "candidate", "labels": "label", "knowledge_items": "knowledge"}
    out: DataFrame | None = None
    for table, name in parts.items():
        df = tables[table]
        if table == "labels":
            df = df.where("label is not null and coalesce(include_in_matching, true)")
        if order:
            df = last_of(df, "sample_id", order)
        df = df.select("sample_id", F.struct(*df.columns).alias(name))
        out = df if out is None else out.join(df, "sample_id")
    return out


def v2_records(raw: DataFrame, split: str = "local", threshold: float = THRESHOLD) -> DataFrame:
    """The later inclusion rule: valid, some additional information, and a score, whatever the file's name says."""
    i, score = F.col("r.input"), raw_score(F.col("r.output.scores.aggregated_scores.macro_scores"), F.col("r.output.scores.aggregated_scores.micro_scores"))
    info = F.coalesce(i["additional_info"], F.lit(""))
    included = F.coalesce("r.output.valid_resume_and_jd", F.lit(False)) & (F.trim(info) != "") & score.isNotNull()
    return raw.select("sample_id", F.lit(split).alias("split"), "source_file", F.when(F.col("source_file").endswith(".json"), F.col("filename_category")).otherwise("hf").alias("filename_category"), included.alias("include_in_matching"),
                      score.alias("raw_score"), F.when(included, label_of(score, threshold)).alias("label"), candidate_text().alias("candidate_text"), job_text().alias("job_text"), knowledge_text().alias("knowledge_text"),
                      info.alias("additional_info"), safe_list(i["minimum_requirements"], _TEXT).alias("minimum_requirements"), i["macro_dict"].alias("macro_dict"), i["micro_dict"].alias("micro_dict"))


def relabelled(records: DataFrame, threshold: float | Column) -> DataFrame:
    """Included records, labelled by another threshold, or by one of each row's own."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return records.where("include_in_matching and raw_score is not null").withColumns({"label": label_of(F.col("raw_score"), threshold), "label_source": F.lit("score_threshold"), "threshold": threshold})


def threshold_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Joined rows of category match that have a score, labelled or not: what a change of threshold starts from."""
    scored = tables["labels"].where("filename_category = 'match' and raw_score is not null").withColumns({"label": F.coalesce("label", F.lit(0)), "include_in_matching": F.lit(True)})
    return join_tables(tables | {"labels": scored})


# --- readers with fallbacks --------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines don't count, and a missing path is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV with a header, all columns strings; None if it is missing."""
    try:
        return spark.read.csv(path, header=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_feature_table(spark: SparkSession, base: str) -> DataFrame:
    """``base.parquet``, else ``base.csv``, else an error that names both."""
    for path, read in ((f"{base}.parquet", spark.read.parquet), (f"{base}.csv", lambda p: spark.read.csv(p, header=True, inferSchema=True))):
        try:
            return read(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"neither {base}.parquet nor {base}.csv")


def dp_matrix_name(epsilon: float, seed: int) -> str:
    return f"dp_embedding_cosine_epsilon_{str(float(epsilon)).replace('.', '_')}_seed_{seed}_matrix"


def read_dp_scores(spark: SparkSession, path: str, epsilon: float, seed: int) -> DataFrame:
    """Private scores of one budget and seed: Spark reads these two partitions only."""
    return spark.read.parquet(path).where((F.col("epsilon") == float(epsilon)) & (F.col("seed") == seed))


def read_matrix(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The matrix or stack of a name; no other's files are read."""
    return spark.read.option("basePath", path).parquet(f"{path}/matrix={name}").drop("matrix")


def read_metadata(path: str) -> dict:
    return json.loads(read_text(path))


def fullest_snapshot(root: str) -> str:
    """The snapshot folder with most JSON files, of equal ones the newest."""
    folders = [p for p in Path(root).glob("*") if p.is_dir()]
    counted = [(len(list(p.glob("*.json"))), p.stat().st_mtime, str(p)) for p in folders]
    if not counted or max(counted)[0] == 0:
        raise FileNotFoundError(f"no snapshot with JSON files under {root}")
    return max(counted)[2]


def load_records(spark: SparkSession, hub: str | None, cache_root: str | None, local: str | None) -> tuple[DataFrame, dict]:
    """Records from the first source that can be read: hub files (one folder a split), a cache of snapshots, a local folder.

    The second value says which, its splits and columns, and why earlier ones failed.
    """
    errors = []
    for name, path in (("hub", hub), ("cache_snapshot", cache_root), ("local_raw", local)):
        if path is None:
            continue
        try:
            if name == "hub":
                splits = sorted(p.name for p in Path(path).iterdir() if p.is_dir())
                if not splits:
                    raise FileNotFoundError(f"no splits under {path}")
                parts = [v2_records(read_raw(spark, os.path.join(path, s), strict=False), s) for s in splits]
            else:
                folder = fullest_snapshot(path) if name == "cache_snapshot" else path
                parts = [v2_records(read_raw(spark, folder, strict=name == "local_raw"), name)]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
            return out, {"source": name, "splits": sizes, "fields": out.columns, "load_error": "; ".join(errors)}
        except (AnalysisException, OSError) as e:
            errors.append(f"{name}: {e!r}"[:300])
    raise FileNotFoundError("; ".join(errors) or "no source given")
