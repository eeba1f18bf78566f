"""Sinks: JSON lines, CSV with the union of all columns, Parquet, and Markdown reports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.storage import write_text


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; null fields stay."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def union_rows(*parts: DataFrame) -> DataFrame:
    """All rows; a column that a part lacks is null there. Columns come in the order in which they first appear."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(path: str, *parts: DataFrame) -> None:
    """A CSV with a header; blank where a value is missing. Result tables are small, so it is one file."""
    union_rows(*parts).coalesce(1).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def write_table(df: DataFrame, base: str) -> str:
    """Parquet, or CSV where Parquet can't hold a column's type or name. Returns its path."""
    try:
        df.write.mode("overwrite").parquet(f"{base}.parquet")
        return f"{base}.parquet"
    except AnalysisException:
        flat = df.select(*(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes))
        flat.write.mode("overwrite").csv(f"{base}.csv", header=True)
        return f"{base}.csv"


def write_matrix(df: DataFrame, path: str, name: str) -> None:
    """A long table (``query, cand, score``, or ids and vectors) under its name: a folder of ``path`` for each, of which readers read one."""
    df.write.mode("overwrite").parquet(f"{path}/matrix={name}")


def write_dp_scores(df: DataFrame, path: str) -> None:
    """Scores of all budgets and seeds, a folder for each: a reader of one reads nothing else."""
    df.write.mode("overwrite").partitionBy("epsilon", "seed").parquet(path)


def write_metadata(path: str, values: dict) -> None:
    """One JSON file, on whatever file system Spark knows by the path."""
    write_text(path, json.dumps(values, indent=2, ensure_ascii=False, default=str) + "\n")


def statistics(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """``metric, value`` (text), a row for each aggregate; all from one pass."""
    one = df.agg(*(a.cast("string").alias(n) for n, a in aggregates.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in aggregates))).alias("x")).select("x.metric", "x.value")


def markdown_table(df: DataFrame, columns: list[str] | None = None) -> str:
    """A Markdown table of a result's rows; numbers with four places, blank where there is none."""
    columns = columns or df.columns
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in df.collect()]) + "\n"


def deltas(df: DataFrame, keys: list[str], method: str, a: str, b: str, metric: str, margin: float = 0.0) -> DataFrame:
    """``keys, delta, stable``: method ``a`` minus ``b`` on a metric, and whether ``a`` leads by more than ``margin`` everywhere."""
    value = lambda m: F.max(F.when(F.col(method) == m, F.col(metric)))
    by = df.groupBy(*keys).agg((value(a) - value(b)).alias("delta"))
    least = by.agg(F.min("delta").alias("_least"))
    return by.crossJoin(F.broadcast(least)).select(*keys, "delta", (F.col("_least") > margin).alias("stable"))  # one row


def loading_report(records: DataFrame, meta: dict) -> str:
    """What was loaded, from where, and how it is labelled."""
    row = records.agg(F.count("*").alias("n"), F.count_if("include_in_matching").alias("included"), F.count_if(F.expr("include_in_matching and label = 1")).alias("positive"), F.count_if(F.expr("include_in_matching and label = 0")).alias("negative")).first()
    categories = {r["filename_category"]: r["count"] for r in records.groupBy("filename_category").count().orderBy("filename_category").collect()}
    report = meta | {"total_loaded_rows": row["n"], "included_valid_scored_rows": row["included"], "positive_count": row["positive"], "negative_count": row["negative"], "filename_categories": categories}
    return "# Loading report\n\n```json\n" + json.dumps(report, indent=2, ensure_ascii=False, default=str) + "\n```\n"


def leakage_report(features: list[str], columns: list[str], targets: list[str], ids: list[str], groups: list[str]) -> str:
    """Which targets and ids are among the features (none may be), and how records could be grouped."""
    lines = ["# Leakage check", "", "| column | kind | in the table | among the features |", "| --- | --- | --- | --- |"]
    for kind, names in (("target", targets), ("id", ids)):
        lines += [f"| {n} | {kind} | {n in columns} | {n in features} |" for n in names]
    found = sorted(set(features) & {*targets, *ids})
    return "\n".join([*lines, "", "Verdict: " + (f"LEAK: {', '.join(found)}" if found else "no target or id among the features") + ".", f"Group columns: {', '.join(groups) or 'none'}.", ""])


def protocol_report(folds: int, seeds: list[int], holdout_seeds: list[int], grouped: bool) -> str:
    return (f"# Validation protocol\n\n- stratified {folds}-fold, seeds {', '.join(map(str, seeds))}\n- stratified 80/20 hold-out, seeds {', '.join(map(str, holdout_seeds))}\n"
            f"- grouped {folds}-fold: {'run' if grouped else 'skipped, no usable groups'}\n")


def inspect(df: DataFrame, category: str) -> str:
    """Columns, and rows of each category in order."""
    counts = df.groupBy(category).count().orderBy(category).collect()
    return "\n".join([f"columns: {', '.join(df.columns)}", *(f"{r[category]}: {r['count']}" for r in counts)]) + "\n"
