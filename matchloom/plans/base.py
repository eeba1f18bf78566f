"""What the named queries stand on: the tables, pairs of a document and its own benchmark item, and SQL for both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import entries_of, token_set

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL twin."""
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded as SQL does it: what a negative number leaves is a negative zero, which Spark's own rounding drops."""
    r = F.round(c, places)
    return F.when(r == 0, c * F.lit(0.0)).otherwise(r)


def own_items(spark: SparkSession, sf_dir: str, docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` joined to ``items`` of their own benchmark item (by ``item_id``), one each.

    The benchmark has a fixed number of items, and Spark decides by its size whether to broadcast it.
    """
    n = table(spark, sf_dir, "benchmark").count()
    return docs.withColumn("item_id", F.pmod("doc_id", F.lit(n))).join(items, "item_id")


def pairs(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    """``doc_id, text, lang, source, n_chars, item_id, jd, raw_score`` of each document and its item, and labels of those that have any."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("jd"))
    out = own_items(spark, sf_dir, table(spark, sf_dir, "documents"), items)
    out = out.select("doc_id", "text", "lang", "source", "n_chars", "item_id", "jd", F.least(F.lit(10.0), F.col("n_chars") / 1000.0).alias("raw_score"))
    return out.join(table(spark, sf_dir, "labels"), "doc_id") if labelled else out


PAIRS = """pairs AS MATERIALIZED (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, b.item_id, b.text AS jd, least(10.0::DOUBLE, d.n_chars / 1000.0::DOUBLE) AS raw_score
  FROM (SELECT *, doc_id % (SELECT count(*) FROM benchmark) AS own FROM documents) d JOIN benchmark b ON b.item_id = d.own),
lp AS (SELECT * FROM pairs JOIN labels USING (doc_id))"""

TOKEN = "[A-Za-z][A-Za-z0-9_+-]{1,}"


def toks(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '{TOKEN}'), lambda t: lower(t))"


def tset(text: str) -> str:
    return f"list_distinct({toks(text)})"


#: SQL functions for the oracle, put in as text.
def jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE ({part})::DOUBLE / ({whole}) END"


def requirements(jd: Column) -> Column:
    """An item's requirements: its sentences."""
    return F.split(jd, r"[.]\s*")


def criteria(jd: Column) -> Column:
    """An item's criteria: its first five distinct tokens in order of the alphabet, three macro and two micro, weights 60, 0, none, 40, 10."""
    keys = F.slice(F.array_sort(token_set(jd)), 1, 5)
    macro = F.map_from_entries(F.transform(F.slice(keys, 1, 3), lambda k, i: F.struct(k, F.when(i == 0, 60.0).when(i == 1, 0.0))))
    micro = F.map_from_entries(F.transform(F.slice(keys, 4, 2), lambda k, i: F.struct(k, F.when(i == 0, 40.0).otherwise(10.0))))
    return entries_of(macro, micro)
