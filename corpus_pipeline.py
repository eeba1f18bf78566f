"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``, in order, whatever further ones there are. Each stage defines what
nulls, empty and long texts, repeated rows and empty tables give in the docstring of the operator that it calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import discard, materialize, written
from matchloom.llm.mixing import draw_mix
from matchloom.llm.neardup import drop_near_duplicates
from matchloom.llm.packing import harmonic_pack
from matchloom.llm.pii import redact_pii, train_pii
from matchloom.llm.queries import TOKENIZER
from matchloom.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of expected grade 0; the model learns from the table ``labels``."""
    return drop_toxic(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, width=5, num=80, den=100)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in angle brackets; ``n_chars`` follows the new text."""
    clean = redact_pii(docs, train_pii(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn and share 150 % of all words, none over twice its own."""
    return draw_mix(docs, 1.5, 2.0, [5, 2, 1])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return harmonic_pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: No SQL: trained models, a tokenizer and signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and the one it read, are deleted as soon as its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        mark = len(written)
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, [*before, *written[mark:-1]])
        before = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
