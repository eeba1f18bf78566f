"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Each worker packs the documents of its own partition, with no exchange between workers:

* a document gives full sequences of ``capacity`` tokens, and a rest;
* the rest is cut into pieces that sit well in a reciprocal-capacity class. Class k holds lengths in
  (capacity / (k + 1), capacity / k], and a bin of class k holds exactly k pieces. A rest that would leave
  more than ``slack`` of its bins empty gives a piece of the class's largest length, floor(capacity / k),
  and what is left of it is cut in the same way;
* at its end a worker has at most k - 1 pieces in each class without a full bin. These follow each other in
  sequences cut at the capacity, and the last, partial sequence is cut at powers of two, which need no padding.

A sequence id holds the worker's number in its upper bits, so ids never clash and a retried task gives the same ones.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import small_batches

CAPACITY = 2048
#: Words of plain Latin text meet the tokenizer's own rules without its normaliser: no composition, one-to-one case.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class CachedEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    Where the tokenizer lower-cases, splits by the pattern of ``_PIECES`` and marks word ends, its pre-tokens
    don't influence each other: those of plain Latin text are encoded once and looked up afterwards. Every
    other text, and every text for another kind of tokenizer, goes to the tokenizer whole. The cache is
    emptied at ``limit`` entries.
    """

    #: Fixed values of the tokenizer file: the split pattern that ``_PIECES`` equals on plain Latin text.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, tokenizer_path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.limit = Tokenizer.from_file(tokenizer_path), {}, limit
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])][:1]
        self.by_word = bool(suffix) and normal == ["NFC", "Replace", "Lowercase"] and split == [self.SPLIT]
        self.ends = {i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)} if self.by_word else set()

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def _learn(self, words: list[str]) -> None:
        ids = self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        found: list[list[int]] = [[]]
        for i in ids:
            found[-1].append(i)
            if i in self.ends:
                found.append([])
        if found.pop() or len(found) != len(words):  # an end that ends no word, or none where a word ends
            found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        self.cache.update(zip(words, map(self.pack, found), strict=True))

    def encode(self, text: str) -> bytes:
        if not self.by_word or "<|" in text or not _PLAIN.fullmatch(text):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = _PIECES.findall(text.lower())
        new = set(words).difference(self.cache)
        if len(self.cache) + len(new) > self.limit:
            self.cache.clear()
            new = set(words)
        if new:
            self._learn(list(new))
        return b"".join(map(self.cache.__getitem__, words))


_encoders: dict[str, CachedEncoder] = {}


def encoder(tokenizer_path: str) -> CachedEncoder:
    """One encoder a worker process, kept from task to task with its cache."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = CachedEncoder(tokenizer_path)
    return _encoders[tokenizer_path]


def piece_lengths(rest: int, capacity: int, slack: float) -> list[int]:
    """The lengths that a rest of under ``capacity`` tokens is cut into."""
    out = []
    while rest:
        k = capacity // rest
        if k * rest >= capacity * (1 - slack):
            out.append(rest)
            break
        top = capacity // (k + 1)
        out.append(top)
        rest -= top
    return out


class HarmonicPacker:
    """Pieces in, (sequence, offset) out, for one worker. A piece is (held, start, length).

    ``held`` is what ``cut(start, length)`` gives when the piece is made: a piece that waits keeps its own ids, not its document's.
    """

    def __init__(self, capacity: int = CAPACITY, slack: float = 0.01):
        self.capacity, self.slack, self.open, self.next = capacity, slack, {}, 0

    def _bin(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield piece, self.next, at
            at += piece[2]
        self.next += 1

    def add(self, cut: Callable[[int, int], object], tokens: int) -> Iterator[tuple]:
        start = 0
        while tokens - start >= self.capacity:
            yield from self._bin([(cut(start, self.capacity), start, self.capacity)])
            start += self.capacity
        for length in piece_lengths(tokens - start, self.capacity, self.slack):
            k = self.capacity // length
            pending = self.open.setdefault(k, [])
            pending.append((cut(start, length), start, length))
            start += length
            if len(pending) == k:
                yield from self._bin(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """What waits, cut further: a piece's start moves within what it holds."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if total % self.capacity >> b & 1]
        i, used = 0, 0
        for size in sizes:
            pieces, room = [], size
            while room:
                held, start, length = left[i]
                take = min(room, length - used)
                pieces.append((held, start + used, take))
                room, used = room - take, used + take
                if used == length:
                    i, used = i + 1, 0
            yield from self._bin(pieces)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class_docs int"


def harmonic_pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  end_id: int = 1, capacity: int = CAPACITY, slack: float = 0.01, with_ids: bool = False) -> DataFrame:
    """Cut and pack ``docs``: one row a piece, with the piece's ids too if ``with_ids``.

    * null or empty text: the end id alone; null id: packed, with a null ``doc_id``;
    * repeated rows: each is packed; empty table: no rows; texts of any length are tokenised whole;
    * other columns of ``docs`` are not read.

    ``class_docs`` is how many pieces a bin of the piece's class holds. ``ids_crc32`` covers the ids as
    little-endian unsigned 32-bit integers. A worker holds its open bins only: under ``capacity`` tokens a class.
    """
    small_batches(docs.sparkSession)
    tail = CachedEncoder.pack([end_id])
    fields = [pa.field(*x) for x in (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("class_docs", pa.int32()))]
    schema = pa.schema(fields + [pa.field("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, base = encoder(tokenizer_path), HarmonicPacker(capacity, slack), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def placed(pieces: Iterator[tuple]) -> None:
            for ((doc, tokens, first, ids), start, length), sequence, offset in pieces:
                cut = ids[4 * (start - first) : 4 * (start - first + length)]
                row = (doc, start, length, zlib.crc32(cut), tokens, base + sequence, offset, capacity // length)
                rows.append(row + (memoryview(cut).cast("I").tolist(),) if with_ids else row)

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for got in batches:
            for doc, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                ids = own.encode(text or "") + tail
                tokens = len(ids) // 4
                placed(packer.add(lambda start, length: (doc, tokens, start, ids[4 * start : 4 * (start + length)]), tokens))  # noqa: B023
                if len(rows) >= 4096:
                    yield batch()
        placed(packer.finish())
        if rows:
            yield batch()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))
