"""Shared plumbing: where intermediate tables go, and vectorised word-shingle hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where driver and executors are one process (tests, a laptop) and the setting is absent a local folder is chosen, once a
    session; a cluster without the setting gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.matchloom.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.matchloom.dir", found)
    return found.rstrip("/")


#: Paths of the tables written by this process, oldest first.
written: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/matchloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing will read again; a caller that has written its result may pass all of ``written``."""
    for path in list(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        written.remove(path)


def small_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Lower the session's rows per Arrow batch to ``rows``, if it is higher: documents are long, and workers hold a batch several times.

    Spark reads the setting when a query starts, so it stays lowered for the session; a caller's lower one is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


# --- shingle hashing -------------------------------------------------------------------------

MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_COEF = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F,
                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (wrap-around arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("n", 0)
    if have < n:
        size = max(n, 1 << 20)
        for key, base in (("pw", _BASE), ("inv", _BASE_INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
        _powers["n"] = size
    return _powers["pw"], _powers["inv"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, in order, and the number of words of each text.

    Words are runs of bytes other than space, tab, LF, VT, FF and CR; A-Z count as a-z.
    Polynomial prefix sums modulo 2**64 give all hashes of a block without a Python loop over words.
    """
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    solid = ~_SPACE[data]
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    pw, inv = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=prefix[1:])
    hashes = mix64((prefix[ends] - prefix[starts]) * inv[starts])
    bounds = 1 + np.concatenate(([0], np.cumsum(lengths)))
    counts = np.diff(np.searchsorted(starts, bounds))
    return hashes, counts


def shingle_sets(texts: list[bytes], width: int, block: int = 1 << 20) -> list[np.ndarray]:
    """The sorted distinct hashes of the ``width``-word shingles of each text.

    A text with fewer words has one shingle, its whole word sequence; one without words has none.
    Texts are hashed in blocks of about ``block`` bytes, so memory follows the longest text.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= block):
            size += len(texts[upto])
            upto += 1
        words, counts = word_hashes(texts[at:upto])
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for t in range(width):
            rolled += words[t : t + n] * _COEF[t]
        rolled = mix64(rolled)
        first = np.concatenate(([0], np.cumsum(counts)))
        for k, c in enumerate(counts):
            s = first[k]
            if c >= width:
                out.append(np.unique(rolled[s : s + c - width + 1]))
            elif c:
                whole = (words[s : s + c] * _COEF[:c]).sum(dtype=np.uint64) + np.uint64(c)
                out.append(mix64(np.array([whole], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        at = upto
    return out


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]
