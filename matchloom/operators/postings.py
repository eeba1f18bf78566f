"""Sums over token sets of some records, for many others: an inverted index that workers hold.

A token set is a slot. Each token of a text adds to the slots that hold it, so all slots are counted at once, and neither texts
nor sets are copied for each pair. Tokens are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of the matrices that a worker holds at once.
CELLS = 1 << 20


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def lists(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin and end."""
    c = batch.column(name)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    if isinstance(c, pa.ChunkedArray):
        c = pa.concat_arrays(c.chunks)
    sizes = np.asarray(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


class Postings:
    """The slots of each token, with a weight (1 if none is given)."""

    def __init__(self, tokens: np.ndarray, slots: np.ndarray, n: int, weights: np.ndarray | None = None):
        order = np.argsort(tokens, kind="stable")
        self.terms, self.starts, self.counts = np.unique(tokens[order], return_index=True, return_counts=True)
        self.slots, self.n = slots[order], n
        self.weights = None if weights is None else weights[order]

    @classmethod
    def of_sets(cls, sets: list) -> Postings:
        """A slot for each of ``sets``, in that order."""
        sizes = [len(s) for s in sets]
        tokens = np.array([t for s in sets for t in s], dtype=np.int64)
        return cls(tokens, np.repeat(np.arange(len(sets)), sizes), len(sets))

    def sums(self, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows x slots: the sum of weights of a row's tokens, repeats counted. ``ends`` as of ``lists``, for these tokens."""
        rows = len(ends) - 1
        if not len(self.terms) or not len(tokens):
            return np.zeros((rows, self.n))
        row = np.repeat(np.arange(rows), np.diff(ends))
        at = np.minimum(np.searchsorted(self.terms, tokens), len(self.terms) - 1)
        hit = self.terms[at] == tokens
        row, at = row[hit], at[hit]
        each = self.counts[at]
        begin = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat(self.starts[at] - begin[:-1], each) + np.arange(begin[-1])
        cells = np.repeat(row * self.n, each) + self.slots[place]
        weights = None if self.weights is None else self.weights[place]
        return np.bincount(cells, weights=weights, minlength=rows * self.n).astype(float).reshape(rows, self.n)


def pieces(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose matrices of ``width`` columns have at most ``CELLS`` cells (a row at least)."""
    step = max(1, CELLS // max(1, width))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``part / whole``, 0 where the whole is 0."""
    return np.divide(part, whole, out=np.zeros(np.broadcast(part, whole).shape), where=whole != 0)


def jaccard(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From sizes: ``a`` of rows, ``b`` of columns; 1 for two empty sets."""
    a, b = a[:, None], b[None, :]
    return np.where((a == 0) & (b == 0), 1.0, ratio(both, a + b - both))


def summed(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Rows x n: sums of the columns of ``values`` by their owner, in order."""
    out = np.zeros((len(values), n))
    for at in range(int(np.bincount(owner, minlength=1).max()) if len(owner) else 0):  # the first column of each owner, then the second
        starts = np.searchsorted(owner, np.arange(n))
        held = np.minimum(starts + at, len(owner) - 1)
        use = (starts + at < len(owner)) & (owner[held] == np.arange(n))
        out[:, use] += values[:, held[use]]
    return out
