"""WARC records, and a Merkle fixity audit of their replicas.

Records stand in the order of (key, hash), null keys first. A record's place in that order gives its file (``file_records``
records each) and its byte offset there. The tree stands on the primary's places: a node of level L covers the ordered offset
range of ``fanout ** L`` records, whatever their keys, and its hash covers the keys or places, lengths and hashes of its children in
order. A replica's record belongs to the place of the last record of the primary that isn't after it, so that a record lost or
put in spoils no range but its own. Hashes leave absolute offsets out for the same reason.

An audit compares the roots of two replicas, then only the children of nodes that differ, down to records.

Equal records are one entry with a count, and order comes from ranges of (key, hash), so neither a hot key nor a hot
record gathers in one task.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize

FANOUT, FILE_RECORDS = 16, 4096
#: Entries in each range that is sorted by one task, and records of the replica alone that one hash covers.
RANGE_ENTRIES, CHUNK = 50_000, 4096
_END = "\r\n\r\n"


def warc_record(key: Column, url: Column, payload: Column) -> Column:
    """The text of one WARC/1.1 resource record without its closing blank lines; nulls count as empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(_END), body)


def _ranges(entries: DataFrame, *more: str) -> tuple[DataFrame, list[Column]]:
    """``entries`` dealt out by ranges of (key, hash) and written, with ``bucket``; and the order in a bucket."""
    n = max(1, -(-entries.count() // RANGE_ENTRIES))
    dealt = entries.repartitionByRange(n, F.col("key").asc_nulls_first(), "hash").withColumn("bucket", F.spark_partition_id())
    return materialize(dealt, "ranges"), [F.col("key").asc_nulls_first(), F.col("hash"), *map(F.col, more)]


def _starts(dealt: DataFrame, **sums: Column) -> DataFrame:
    """``bucket`` and the sums over all earlier buckets: a row a bucket."""
    totals = dealt.groupBy("bucket").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("bucket", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums))


def manifest(records: DataFrame, key_col: str, record: Column) -> DataFrame:
    """``key, hash, length, n``: the sha256 and bytes of every distinct record, and how often its key has it.

    Written to the shared folder: the records themselves are read once, and counted before they move. Keys may be null or repeated.
    """
    hashed = records.select(F.col(key_col).cast("long").alias("key"), F.sha2(record.cast("binary"), 256).alias("hash"), F.octet_length(record).cast("long").alias("length"))
    return materialize(hashed.groupBy("key", "hash", "length").agg(F.count("*").alias("n")), "manifest")


def _placed(entries: DataFrame) -> DataFrame:
    """``entries`` (``key, hash, n`` and any columns) with ``place``: the number of records before theirs."""
    dealt, order = _ranges(entries)
    inside = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = _starts(dealt, start=F.col("n"))
    return dealt.join(F.broadcast(start), "bucket").withColumn("place", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("bucket", "start")


def places(entries: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """``key, file_no, offset, length, hash`` of every record of a manifest: its file, and its place there in bytes."""
    copies = _placed(entries).select("key", "hash", "length", F.posexplode(F.expr("sequence(1L, n)")).alias("i", "_copy"), "place")
    filed = copies.withColumn("place", F.col("place") + F.col("i")).withColumn("file_no", F.expr(f"place div {file_records}"))
    before = Window.partitionBy("file_no").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return filed.select("key", "file_no", F.coalesce(F.sum(F.col("length") + len(_END)).over(before), F.lit(0)).alias("offset"), "length", "hash")


def write_warc(records: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_records: int = FILE_RECORDS) -> None:
    """Write WARC files under ``path/file_no=N/``, at the places that :func:`places` tells of a manifest of the same records.

    Null and repeated keys are written as they are, nulls in url and payload as empty; an empty table writes no file.
    A record moves to its place, found by its key and hash, and then to its file. Of repeated records one moves on, and is copied at the file.
    """
    value = warc_record(F.col(key_col), F.col(url_col), F.col(payload_col))
    found = materialize(_placed(manifest(records, key_col, value)).select(F.col("key").alias("k"), F.col("hash").alias("h"), "n", "place"), "places")
    named = records.select(F.col(key_col).cast("long").alias("key"), value.alias("value")).withColumn("hash", F.sha2(F.col("value").cast("binary"), 256))
    held = named.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")))
    repeated = held.where("n > 1").groupBy("place").agg(F.first("value").alias("value"), F.first("n").alias("n"))
    copies = held.where("n = 1").select("value", "place").unionByName(repeated.select("value", F.explode(F.expr("sequence(place, place + n - 1)")).alias("place"))).withColumn("file_no", F.expr(f"place div {file_records}"))
    copies.repartition("file_no").sortWithinPartitions("file_no", "place").select("file_no", "value").write.partitionBy("file_no").option("lineSep", _END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``path, offset, length, target_uri, headers, payload`` of every record of WARC files, gzipped or not.

    ``offset`` and ``length`` count the bytes of the record, without its closing blank lines, in the unpacked
    file. A file is the unit of reading, as Spark's binary source has it, and a task holds one at a time, of any number of files and
    records. An empty file has no records; a malformed one raises an error that names it.
    """
    def records(path: str, data: bytes) -> Iterator[tuple]:
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        at = 0
        while at < len(data):
            end = data.find(b"\r\n\r\n", at)
            head = data[at:end].decode() if end > 0 else ""
            named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}
            if not head.startswith("WARC/") or not named.get("content-length", "").isdigit():
                raise ValueError(f"no WARC record at byte {at} of {path}")
            stop = end + 4 + int(named["content-length"])
            if stop > len(data):
                raise ValueError(f"the record at byte {at} of {path} is cut short")
            yield path, at, stop - at, named.get("warc-target-uri"), head, data[end + 4 : stop]
            at = stop + 4

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    # Rows, not Arrow batches: a batch would hold thousands of whole files.
    found = files.rdd.flatMap(lambda r: records(r["path"], bytes(r["content"])))
    return spark.createDataFrame(found, "path string, offset long, length long, target_uri string, headers string, payload binary", verifySchema=False)


def _parents(level: DataFrame, fanout: int) -> DataFrame:
    child = F.array_sort(F.collect_list(F.struct("node", "hash", "length")))
    text = F.array_join(F.transform(child, lambda c: F.concat_ws(":", c["node"], c["length"], c["hash"])), ",")
    return level.groupBy(F.expr(f"node div {fanout}").alias("node")).agg(F.sha2(text, 256).alias("hash"), F.sum("length").alias("length"))


def merkle_levels(entries: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """``node, hash, length`` of each level from the first up, of ``place, chunk, key, hash, length, n``; the last is the root.

    Each level is written, so that an audit reads of a level what it descends to and computes nothing twice. A
    shuffle carries hashes only, and each level is ``fanout`` times smaller than the one below. Entries of chunk 0 are the primary's own, at most
    ``fanout`` a node; others come in chunks of bounded size, whose hashes their node covers.
    """
    child = F.array_sort(F.collect_list(F.struct(F.col("key").isNotNull().alias("k"), "key", "hash", "length", "n")))
    text = F.array_join(F.transform(child, lambda c: F.concat_ws(":", F.coalesce(c["key"].cast("string"), F.lit("")), c["length"], c["hash"], c["n"])), ",")
    chunks = entries.groupBy(F.expr(f"place div {fanout}").alias("node"), "chunk").agg(F.sha2(text, 256).alias("hash"), F.sum(F.col("length") * F.col("n")).alias("length"))
    own = F.array_sort(F.collect_list(F.struct("chunk", "hash")))
    first = chunks.groupBy("node").agg(F.sha2(F.array_join(F.transform(own, lambda c: c["hash"]), ","), 256).alias("hash"), F.sum("length").alias("length"))
    out = [materialize(first, "merkle")]
    for _ in range(levels - 1):
        out.append(materialize(_parents(out[-1], fanout), "merkle"))
    return out


def _on_primary(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Entries of both sides at places of the primary: ``side, place, chunk, key, hash, length, n``, side 0 the primary's.

    A replica's entry that the primary has too (with any count) is at its place, in chunk 0; any other at the place of the last one before.
    """
    both = primary.withColumn("side", F.lit(0)).unionByName(replica.withColumn("side", F.lit(1)))
    dealt, order = _ranges(both, "side")
    own = F.when(F.col("side") == 0, F.col("n")).otherwise(0)
    upto = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("side") == 0, F.struct(F.col("place").alias("place"), "key", "hash")), ignorenulls=True).over(upto)
    counted = dealt.join(F.broadcast(_starts(dealt, start=own)), "bucket").withColumn("place", F.col("start") + F.sum(own).over(upto) - own)
    found = counted.withColumn("at", last).withColumn("row", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
    same = F.col("at.key").eqNullSafe(F.col("key")) & (F.col("at.hash") == F.col("hash"))
    place = F.when(F.col("at").isNotNull(), F.col("at.place")).otherwise(F.greatest(F.col("start") - 1, F.lit(0)))
    chunk = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1 + F.expr(f"bucket * {RANGE_ENTRIES} + row div {CHUNK}"))
    return found.select("side", place.alias("place"), chunk.cast("long").alias("chunk"), "key", "hash", "length", "n")


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Compare two manifests. Returns the differing records and the roots.

    The first is ``key, hash, lost, status``, a row a key and hash of the primary that the replica lacks (``lost`` of its
    copies), and one with a null ``hash`` a key for what the replica has besides. ``status`` is that of the key: 'changed' if the
    replica lacks records of it and has others, 'missing' if it lacks some, 'extra' if it has more. The second is
    ``side, hash``. Equal roots end the audit at once, with no row.

    An empty manifest has no root; against another all of the other's keys are missing or extra; two give no rows.
    """
    spark = primary.sparkSession
    placed = materialize(_on_primary(primary, replica), "placed")
    last, levels = placed.where("side = 0").agg(F.max("place")).first()[0] or 0, 1
    while fanout**levels <= last:
        levels += 1
    a, b = (merkle_levels(placed.where(f"side = {side}"), levels, fanout) for side in (0, 1))
    roots = a[-1].select(F.lit("primary").alias("side"), "hash").unionByName(b[-1].select(F.lit("replica").alias("side"), "hash"))
    nodes: DataFrame | None = None
    for left, right in zip(reversed(a), reversed(b), strict=True):
        if nodes is not None:  # only children of branches that differ
            held = nodes.select(F.col("node").alias("parent"))
            left, right = (x.join(held, F.expr(f"node div {fanout}") == F.col("parent"), "left_semi") for x in (left, right))
        both = left.select("node", F.col("hash").alias("ha")).join(right.select("node", F.col("hash").alias("hb")), "node", "full")
        nodes = materialize(both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("node"), "differing")
        if nodes.isEmpty():
            return spark.createDataFrame([], "key long, hash string, lost long, status string"), roots
    suspects = placed.join(nodes, F.expr(f"place div {fanout}") == F.col("node"), "left_semi")
    counts = suspects.groupBy("key", "hash").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(-F.col("n"))).alias("lost")).where("lost <> 0")
    per_key = counts.groupBy("key").agg(F.max("lost").alias("most"), F.min("lost").alias("least"))
    status = F.when((F.col("most") > 0) & (F.col("least") < 0), "changed").when(F.col("most") > 0, "missing").otherwise("extra")
    named = materialize(per_key.select(F.col("key").alias("k"), "least", status.alias("status")), "found")
    lost = counts.where("lost > 0").join(named, F.col("key").eqNullSafe(F.col("k"))).select("key", "hash", "lost", "status")
    besides = named.where("least < 0").select(F.col("k").alias("key"), F.lit(None).cast("string").alias("hash"), F.lit(0).cast("long").alias("lost"), "status")
    return lost.unionByName(besides), roots
