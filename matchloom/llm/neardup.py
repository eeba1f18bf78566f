"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

Plan, in stages that each survive a lost executor (tables between them lie in the shared folder):

1. every whole text becomes its set of word shingles, a SuperMinHash signature and its band hashes;
2. equal sets collapse to one class (map-side combined, so a hot group of copies costs one row a task);
3. every class meets the smallest class of each of its bands: a star of links a bucket, never its pairs.
   The components of these links are the candidate groups, which hold any two classes that share a band;
4. each group is verified on full sets, once for all bands. A breadth-first search over an inverted index of a task's
   shingles finds the links and returns a spanning forest only. A group above ``block_shingles`` is dealt out in blocks, and each
   block is verified with a few anchors that all blocks of the group share. That links nearly all of a large group of near copies.
   What is outside its largest component then meets every block: the work grows with the group times what is left over, and
   with the square of the group only where most of it isn't linked at all;
5. the components of the verified links give ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import _COEF, materialize, mix64, shingle_sets, small_batches, text_bytes

BANDS, ROWS = 48, 6
#: Shingles that a task verifies at a time, and members of a larger group that all its tasks share.
BLOCK_SHINGLES, ANCHORS = 50_000, 8
#: So many groups above that size are broadcast, a row each; more are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: So many members of groups, four numbers each, are broadcast to the texts; more are joined by shuffle.
BROADCAST_MEMBERS = 1_000_000


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures (one row a set) of sets of 64-bit hashes; empty sets give all ones.

    Each element walks its own random permutation of the slots: at step j it offers j + r, r uniform in
    [0, 1), to the j-th slot of its permutation. The values are kept as j * 2**32 + r * 2**32. A set stops as
    soon as no slot holds a value of j or more, so nothing that a later step offers could lower one.
    All sets of a call go through the steps together.
    """
    n_sets = len(sets)
    sig = np.full(n_sets * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n_sets)
    if not sizes.sum():
        return sig.reshape(n_sets, slots)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(n_sets), sizes)
    perm = None
    for j in range(slots):
        if j:
            worst = sig.reshape(n_sets, slots).max(axis=1)
            live = (worst >> np.uint64(32)) >= np.uint64(j)
            keep = live[owner]
            if not keep.any():
                break
            if keep.mean() < 0.8:  # steps that are no longer needed change nothing; dropping them costs a copy
                items, owner = items[keep], owner[keep]
                perm = perm[keep] if perm is not None else None
                last = last[keep]
            if perm is None:  # made only when some set needs a second step
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(items), 1))
                perm[np.arange(len(items)), last] = 0
                perm[:, 0] = last
        drawn = mix64(items + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = drawn & np.uint64(0xFFFFFFFF)
        k = j + ((drawn >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = last = k
        else:
            row = np.arange(len(items))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
            perm[row, j] = slot
            last = k
        np.minimum.at(sig, owner * slots + slot, r + np.uint64(j << 32))
    return sig.reshape(n_sets, slots)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash a band, with the band's number mixed in."""
    parts = sig.reshape(len(sig), bands, rows)
    acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), 1))
    for t in range(rows):
        acc = mix64(acc + parts[:, :, t] * _COEF[t])
    return acc.view(np.int64)


def _sign(width: int, bands: int, rows: int, chunk: int = 20_000):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = shingle_sets(text_bytes(part.column(1)), width)
                hashed = np.zeros((len(sets), bands), dtype=np.int64)
                order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
                i = 0
                while i < len(order):  # sets of like size go together: small ones need many steps
                    upto, size = i, 0
                    while upto < len(order) and (upto == i or size + len(sets[order[upto]]) <= chunk) and upto - i < 2048:
                        size += len(sets[order[upto]])
                        upto += 1
                    own = order[i:upto]
                    hashed[own] = band_hashes(superminhash([sets[x] for x in own], bands * rows), bands, rows)
                    i = upto
                values = pa.array(hashed.reshape(-1))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), values),
                ], schema=schema)

    return run


def linked(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links den * |A and B| >= num * |A or B| among ``sets`` (places in the list)."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(item, kind="stable")
    holders, heads = owner[order], np.concatenate(([0], np.cumsum(np.bincount(item))))
    first = np.concatenate(([0], np.cumsum(sizes)))
    open_, out = np.ones(n, dtype=bool), []
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed], queue = False, [seed]
        while queue and open_.any():
            x = queue.pop()
            own = item[first[x] : first[x + 1]]
            spans = heads[own + 1] - heads[own]
            at = np.repeat(heads[own] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
            both = np.bincount(holders[at], minlength=n)
            found = np.flatnonzero(open_ & (den * both >= num * (sizes + sizes[x] - both)) & (both > 0))
            open_[found] = False
            queue += found.tolist()
            out += [(x, int(y)) for y in found]
    return out


def _verify(width: int, num: int, den: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        found = linked(shingle_sets(texts, width), num, den)
        return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for k, doc, text in zip(keys, batch.column(3).to_pylist(), text_bytes(batch.column(4)), strict=True):
                if k != key:
                    if len(ids) > 1:
                        yield links(ids, texts)
                    key, ids, texts = k, [], []
                ids.append(doc)
                texts.append(text)
        if len(ids) > 1:
            yield links(ids, texts)

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: for every node of the ``(u, v)`` links the smallest node reachable.

    Each round hangs every node below its smallest neighbour, shortens the chains by pointer jumping until
    each node points at a root, and keeps the links between different roots. The number of roots
    falls geometrically; only links and pointers move, by shuffles that combine on the map side.
    """
    labels: DataFrame | None = None
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tree = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "tree")
        while True:
            up = tree.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            tree = materialize(tree.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "tree")
            if tree.where("moved").isEmpty():
                break
        tree = tree.select("u", "p")
        if labels is None:
            labels = tree.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = tree.select(F.col("u").alias("component"), "p")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        labels = materialize(labels, "labels")
        a = tree.select("u", F.col("p").alias("pu"))
        b = tree.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = materialize(edges.join(a, "u").join(b, "v").where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "links")
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100,
                    bands: int = BANDS, rows: int = ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Group documents whose shingle sets satisfy ``den * |A and B| >= num * |A or B|``, transitively.

    Returns ``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    * null or blank text: empty set, linked with nothing, ``n_shingles`` 0, kept;
    * fewer words than ``width``: the whole word sequence is the one shingle;
    * null id: takes no part in linking; ``component_id`` null, kept;
    * repeated id: one node; its rows share the component of any of them;
    * empty table: no rows. Other columns of ``docs`` are not read, whatever their names.

    Two sets of similarity s share a band with probability 1 - (1 - s**rows)**bands: at s = 0.8 the
    defaults miss 5 of 10 million links; each found link is confirmed on the full sets.
    """
    small_batches(docs.sparkSession)
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(rows_in.mapInArrow(_sign(width, bands, rows), "doc_id long, n_shingles long, set_hash binary, bands array<long>"), "signed")
    classes = materialize(
        signed.where("doc_id is not null and set_hash is not null").groupBy("set_hash")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("rep", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other")).where("pivot <> other").select("band", "pivot")
    stars = entries.join(buckets, "band").where("rep <> pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
    groups = connected_components(stars)

    weighed = groups.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    per_group = weighed.groupBy("component").agg(F.sum("n").alias("total"), F.min("node").alias("least"), *(F.min_by("node", F.xxhash64("node", F.lit(j))).alias(f"a{j}") for j in range(1, ANCHORS)))
    # Only groups above a block, which are few, join back to their members: a hot group's members don't move for it.
    big = materialize(per_group.where(F.col("total") > block_shingles).select(
        F.col("component").alias("of"), F.ceil(F.col("total") / block_shingles).cast("int").alias("blocks"), F.array("least", *(f"a{j}" for j in range(1, ANCHORS))).alias("anchors")), "groups")
    few = lambda df, count: F.broadcast(df) if count <= BROADCAST_GROUPS else df
    n_big = big.count()
    sized = materialize(weighed.join(few(big, n_big), F.col("component") == F.col("of"), "left").withColumn("k", F.coalesce("blocks", F.lit(1)))
                        .withColumn("block", F.expr("cast(pmod(xxhash64(node, 3), k) as int)"))
                        .select("component", "node", "n", "k", "block", F.coalesce(F.array_contains("anchors", F.col("node")), F.lit(False)).alias("anchor")), "sized")

    def verified(tasks: DataFrame) -> DataFrame:
        """Links among the members of each task: ``component, a, b`` name it, ``doc_id`` is the member."""
        tasks = materialize(tasks, "tasks")
        # Texts move once, to their tasks, while the members' ids fit a broadcast. Of a repeated id all rows come along, as nodes of that id,
        # and the search links them by their own sets.
        texts = rows_in.join(F.broadcast(tasks) if tasks.count() <= BROADCAST_MEMBERS else tasks, "doc_id").select("component", "a", "b", "doc_id", "text")
        return texts.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "doc_id").mapInArrow(_verify(width, num, den), "u long, v long")

    blocks = F.when(F.col("anchor"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("block"))
    found = materialize(verified(sized.select("component", F.explode(blocks).alias("a"), F.lit(0).alias("b"), F.col("node").alias("doc_id"))), "found")
    if n_big:
        large = sized.where("k > 1")
        labels = connected_components(found).withColumnRenamed("component", "label")
        held = materialize(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "large")
        by_label = held.groupBy("component", "label").agg(F.sum("n").alias("m"))
        main = by_label.groupBy(F.col("component").alias("of")).agg(F.max(F.struct("m", "label"))["label"].alias("main"), (F.sum("m") - F.max("m")).alias("rest"))
        left = held.join(few(main.where("rest > 0"), n_big), F.col("component") == F.col("of")).withColumn("kb", F.ceil(F.col("rest") / block_shingles).cast("int")).withColumn("other", F.col("label") != F.col("main"))
        rest = materialize(left.withColumn("spare", F.expr("cast(pmod(xxhash64(node, 5), kb) as int)")).select("component", "node", "k", "kb", "block", "spare", "other"), "rest")
        every = rest.select("component", F.col("block").alias("a"), F.explode(F.expr("sequence(0, kb - 1)")).alias("b"), F.col("node").alias("doc_id"))
        others = rest.where("other").select("component", F.explode(F.expr("sequence(0, k - 1)")).alias("a"), F.col("spare").alias("b"), F.col("node").alias("doc_id"))
        found = found.unionByName(materialize(verified(every.unionByName(others).distinct()), "found"))
    # A repeated id with different sets joins their classes.
    named_rows = signed.where("doc_id is not null and set_hash is not null").select("doc_id", "set_hash")
    repeated = named_rows.groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("b")).where("a <> b").select("doc_id")
    same_id = named_rows.join(repeated, "doc_id").join(classes.select("set_hash", "rep"), "set_hash").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = found.unionByName(same_id)
    final = connected_components(links)
    named = classes.select("set_hash", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    return signed.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id and then text; all columns stay, whatever their names.

    Rows with the same id are judged by their own texts: only near copies go, and of blank rows of an id one stays. Of rows that tie in
    id and text the one stays whose other columns hash smallest. Rows with null ids all stay. Empty table: no rows.
    """
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    held, n, row, group, own = (mark + c for c in ("id", "n", "row", "group", "own"))
    key = F.col(id_col).cast("long")
    repeated = materialize(docs.where(F.col(id_col).isNotNull()).groupBy(key.alias(held)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(held), "repeated")
    if repeated.isEmpty():
        gone = near_duplicates(docs, id_col, text_col, **how).where(~F.col("kept")).select(F.col("doc_id").alias(held)).distinct()
        return docs.join(gone, key == F.col(held), "left_anti")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")  # rows are the nodes
    rows = keyed.where(F.col(id_col).isNotNull())
    found = near_duplicates(rows, row, text_col, **how).select(F.col("doc_id").alias(row), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias(group))
    order = F.struct(key.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.to_json(F.struct(*docs.columns))).alias("rest"), F.col(row).alias("row"))
    ranked = rows.select(row, order.alias(own)).join(found, row)
    first = ranked.groupBy(group, F.when(F.col(group).isNull(), F.col(own)["id"])).agg(F.min(own).alias(own)).select(F.col(own)["row"].alias(row))
    return keyed.join(first, row, "left_semi").select(*docs.columns).unionByName(keyed.where(F.col(id_col).isNull()).select(*docs.columns))
