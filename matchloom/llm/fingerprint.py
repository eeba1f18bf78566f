"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k smallest distinct 64-bit hashes of a text's shingles. Sketches merge by keeping the k
smallest of their union, so parts of a document or of a corpus can be sketched anywhere and joined later. Two
sketches estimate resemblance, containment and the number of distinct shingles.

As text a sketch is ``k:n:`` and the base64 of its sorted little-endian hashes; n is 1 where the sketch is
complete (under k hashes were seen), so that its size is the exact count.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import shingle_sets, small_batches

K = 128
_FULL = float(1 << 64)


class Sketch:
    """The ``k`` smallest of a set of 64-bit hashes; ``complete`` if the set had fewer than ``k``."""

    __slots__ = ("complete", "hashes", "k")

    def __init__(self, hashes: np.ndarray, k: int = K, complete: bool | None = None):
        self.k, self.hashes = k, hashes[:k]
        self.complete = len(hashes) < k if complete is None else complete

    @classmethod
    def of(cls, texts: list[bytes], width: int, k: int = K) -> list[Sketch]:
        return [cls(s, k) for s in shingle_sets(texts, width)]

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of the union; of unlike sizes the smaller k holds."""
        k = min(self.k, other.k)
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(both, k, self.complete and other.complete and len(both) < k)

    def distinct(self) -> float:
        """Estimated number of distinct shingles; exact below k."""
        return float(len(self.hashes)) if self.complete or not len(self.hashes) else (len(self.hashes) - 1) * _FULL / float(self.hashes[-1])

    def _shared(self, other: Sketch) -> tuple[int, int, Sketch]:
        union = self.merge(other)
        held = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return int(np.isin(union.hashes, held, assume_unique=True).sum()), len(union.hashes), union

    def resemblance(self, other: Sketch) -> float:
        """Estimated Jaccard similarity; 1 for two empty texts, 0 for one."""
        shared, size, _ = self._shared(other)
        return shared / size if size else 1.0

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that ``other`` has too; 1 for an empty text."""
        shared, size, union = self._shared(other)
        own = self.distinct()
        return min(1.0, shared / size * union.distinct() / own) if own else 1.0

    def __str__(self) -> str:
        return f"{self.k}:{int(self.complete)}:{base64.b64encode(self.hashes.astype('<u8').tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Sketch:
        k, complete, data = text.split(":")
        return cls(np.frombuffer(base64.b64decode(data), dtype="<u8"), int(k), complete == "1")


def merge_fingerprints(sketches: DataFrame, keys: list[str], column: str = "fingerprint") -> DataFrame:
    """One fingerprint for each combination of ``keys``: partial merges in every task, then one a key.

    Null fingerprints are passed over. A key's rows are merged as they stream by, so a hot key needs no more
    memory than another; the first pass leaves one row a task and key.
    """
    schema = pa.schema([pa.field(k, pa.string()) for k in keys] + [pa.field(column, pa.string())])
    rows = sketches.select(*(F.col(k).cast("string").alias(k) for k in keys), F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([key[i] for key in held], pa.string()) for i in range(len(keys))), pa.array([str(s) for s in held.values()], pa.string())], schema=schema)

        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Sketch.parse(text)
                held[tuple(key)] = held[tuple(key)].merge(own) if tuple(key) in held else own
            if len(held) >= 20_000:
                yield out()
                held.clear()
        yield out()

    ddl = ", ".join(f"`{f.name}` string" for f in schema)
    partial = rows.mapInArrow(run, ddl)
    return partial.repartition(*keys).mapInArrow(run, ddl) if keys else partial.coalesce(1).mapInArrow(run, ddl)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, k: int = K) -> DataFrame:
    """``doc_id, n_chars, fingerprint, n_distinct`` of every whole text, in one pass without a shuffle.

    Null text: empty, and an empty text has an empty, complete sketch. Under ``width`` words: the whole
    sequence is the one shingle. Repeated rows and null ids: a row each. Empty table: no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string()), ("n_distinct", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            own = Sketch.of([t.encode() for t in texts], width, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(str, own), pa.string()), pa.array([s.distinct() for s in own], pa.float64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string, n_distinct double")


#: At most so many ranges, and sampled ids for each of them.
RANGES, SAMPLED = 1 << 16, 20


def _bucket_of(bounds: list[int]):
    """A UDF of (key, hash of the text): how many of the sorted ``bounds`` are at most the key.

    A key that is several bounds at once is hot, and its rows are dealt to as many ranges by the hash.
    """
    held = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series, h: pd.Series) -> pd.Series:
        keys = key.to_numpy()
        first, last = np.searchsorted(held, keys, side="left"), np.searchsorted(held, keys, side="right")
        share = (h.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        within = np.minimum((share * (last - first)).astype(np.int64), np.maximum(last - first - 1, 0))
        return pd.Series(np.where(last - first > 1, first + 1 + within, last).astype(np.int32))

    return bucket


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 500) -> DataFrame:
    """Deal ``docs`` out by ranges of ids, each sorted, with the row that follows each range at its end.

    Returns ``bucket, own, doc_id, text``. A bounded sample of ids (the driver gets no more than that, and a row a range) gives the
    bounds of ranges of about ``rows_per_range`` rows; another pass over the ids finds where each range begins. The texts of
    the rows that begin a range are read apart and follow the range before as its end, with ``own`` false; after the
    last range follows the first row of all. All other texts move once. Null ids count as the smallest id of all, equal ids
    are ordered by a hash of their text, and an id that fills several ranges is dealt to them in that order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    count = docs.count()
    n = max(1, min(RANGES, -(-count // rows_per_range)))
    sampled = sorted(r["key"] for r in rows.select("key").sample(min(1.0, SAMPLED * n / max(1, count)), seed=7).collect())
    bounds = [sampled[len(sampled) * i // n] for i in range(1, n)] if sampled else []
    hot = len(set(bounds)) < len(bounds)
    order = F.xxhash64("text")
    bucket = _bucket_of(bounds)
    # Texts are read in this pass only if an id fills a range alone.
    keyed = rows.withColumn("h", order if hot else F.lit(0).cast("long")).select("key", "h", bucket("key", "h").alias("bucket"))
    begins = keyed.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("b")).select("bucket", "b.*").collect() if hot else keyed.groupBy("bucket").agg(F.min("key").alias("key")).collect()
    begins = sorted(begins, key=lambda r: r["bucket"])
    before = [(r["bucket"], r["key"], r["h"] if hot else None, begins[i - 1]["bucket"]) for i, r in enumerate(begins)]
    heads = docs.sparkSession.createDataFrame(before, "own_bucket int, head long, head_hash long, after int")  # a row a range
    dealt = rows.withColumn("h", order).withColumn("bucket", bucket("key", "h"))
    at_head = (F.col("key") == F.col("head")) & (F.col("head_hash").isNull() | (F.col("h") == F.col("head_hash")))
    if hot:
        at_head = at_head & (F.col("bucket") == F.col("own_bucket"))
    source = dealt if hot else rows.withColumn("h", order)
    closing = source.join(F.broadcast(heads), at_head).groupBy("after").agg(F.min(F.struct("h", "text", "key", "doc_id")).alias("c"))
    ends = closing.select(F.col("after").alias("bucket"), F.lit(False).alias("own"), F.col("c.key").alias("key"), F.col("c.h").alias("h"), F.col("c.doc_id").alias("doc_id"), F.col("c.text").alias("text"))
    every = dealt.select("bucket", F.lit(True).alias("own"), "key", "h", "doc_id", "text").unionByName(ends)
    # Four ranges a partition even out that some get more of them than others.
    return every.repartition(max(1, -(-n // 4)), "bucket").sortWithinPartitions("bucket", F.desc("own"), "key", "h", "text").select("bucket", "own", "doc_id", "text")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, k: int = K, rows_per_range: int = 500) -> DataFrame:
    """Fingerprint each text, an edited text and the next text, and estimate their likeness.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many (or all) from
    the start of the next document, in ascending order of id; after the last document comes the first.

    Null text: empty. Null ids come first in the order. Equal ids follow each other by a hash of the text. A single
    document follows itself. Empty table: no rows. Two empty texts have likeness 1.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                        ("n_distinct", pa.float64()), ("contained_in_edited", pa.float64())])

    def compared(part: list[tuple[int, str]]) -> pa.RecordBatch:
        """Rows for all of ``part`` but its last, which is the successor of the one before."""
        texts = [t for _, t in part]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:], strict=False)]
        raw = [t.encode() for t in edited]
        own, new = Sketch.of([t.encode() for t in texts], width, k), Sketch.of(raw, width, k)
        here = range(len(edited))
        return pa.RecordBatch.from_arrays([
            pa.array([part[i][0] for i in here], pa.int64()), pa.array([len(texts[i]) for i in here], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([str(own[i]) for i in here], pa.string()), pa.array(map(str, new), pa.string()),
            pa.array([own[i].resemblance(new[i]) for i in here], pa.float64()), pa.array([own[i].resemblance(own[i + 1]) for i in here], pa.float64()),
            pa.array([own[i].distinct() for i in here], pa.float64()), pa.array([own[i].containment(new[i]) for i in here], pa.float64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        bucket = None
        for batch in batches:
            for b, own, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    held, bucket = [], b
                held.append((doc, text))
                if not own or len(held) > 256:
                    if len(held) > 1:
                        yield compared(held)
                    held = held[-1:]

    small_batches(docs.sparkSession)
    dealt = in_order_with_next(docs, id_col, text_col, rows_per_range)
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, contained_in_edited double")
