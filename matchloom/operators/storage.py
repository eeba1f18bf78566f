"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back: short plans, and nothing to redo if executors are lost.

    Only where driver and executors are one process (tests, a laptop) and the setting is absent a local folder is chosen, once a
    session; a cluster without the setting gets an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.matchloom.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.matchloom.dir", root)
    path = f"{root.rstrip('/')}/matchloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file(path: str) -> tuple:
    """The path, and its file system, as Spark resolves it: local, or shared by the cluster."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration()), spark


def write_text(path: str, text: str) -> None:
    where, files, _ = _file(path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(path: str) -> str:
    where, files, spark = _file(path)
    held = files.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(held)).decode()
    finally:
        held.close()
