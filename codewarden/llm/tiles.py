"""Cells of vector rows, streamed through a task, and heaps of the best per query.

A cell is a set of queries and a set of candidates that meet in one task.  Rows
arrive sorted by cell, queries first, so a task holds the queries of one cell
and one batch of candidates at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores of a tile: queries times candidates compared at once.
TILE = 1 << 18


def finite(vector: str) -> Column:
    """The vector is there and has neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def one_per_id(rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Of rows that share an id the first in this order.  Only repeated ids move."""
    from ..session import cut_lineage

    again = cut_lineage(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_cw_n")).filter("_cw_n > 1").select(id_col))
    if again.isEmpty():
        return rows
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    met = rows.join(again, id_col).withColumn("_cw_first", first).filter("_cw_first = 1")
    return rows.join(again, id_col, "left_anti").unionByName(met.drop("_cw_first"))


def matrix(column: pa.Array, dtype, width: int | None = None) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = max(int(size.max(initial=0)), width or 0)
    if len(size) and (size == wide).all():
        return flat.reshape(len(size), wide)
    out = np.zeros((len(size), wide), dtype)
    out[np.arange(wide) < size[:, None]] = flat
    return out


def streamed(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of batches with constant ``keys``, which hold no nulls; rows are sorted by them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(c[a].as_py() for c in cols), batch.slice(a, b - a)


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` queries: smaller scores first, then smaller ids."""

    def __init__(self, n: int, k: int, dtype, worst):
        self.k = k
        self.score = np.full((n, k), worst, dtype)
        self.id = np.zeros((n, k), np.int64)
        self.size = np.zeros(n, np.int64)

    def bound(self) -> np.ndarray:
        """A score must be below this to enter, or equal with a smaller id; the worst value while there is room."""
        return self.score[:, -1]

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Add entries; equal (row, score, id) count once."""
        if not len(row):
            return
        touched = np.unique(row)
        held = np.arange(self.k) < self.size[touched, None]
        row = np.concatenate([np.repeat(touched, self.size[touched]), row])
        score = np.concatenate([self.score[touched][held], score])
        ids = np.concatenate([self.id[touched][held], ids])
        order = np.lexsort((ids, score, row))
        row, score, ids = row[order], score[order], ids[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        row, score, ids = row[new], score[new], ids[new]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(start, np.diff([*start, len(row)]))
        use = rank < self.k
        row, score, ids, rank = row[use], score[use], ids[use], rank[use]
        self.score[row, rank], self.id[row, rank] = score, ids
        self.size[touched] = np.bincount(row, minlength=len(self.size))[touched]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of all that is held."""
        held = np.arange(self.k) < self.size[:, None]
        return np.nonzero(held)[0], self.score[held], self.id[held]
