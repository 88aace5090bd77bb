"""Hard-negative mining with Strassen products of integer vectors.

Components become ``floor(scale * x)``; a score is the integer inner product
with an anchor.  Anchors and candidates meet in a grid of cells: anchors in
groups, candidates in chunks, each group with each chunk once.  In a cell, tiles
of anchors and candidates are multiplied by Strassen's recursion on 64-bit
integers - halves padded with zeros where a side is odd, sums exact in any order
- and the scores go to heaps.  A first pass fills the heaps of positives, among
candidates of the anchor's label only; a second one those of the windows, one for
each anchor and positive.  Heaps of different cells merge by taking the best of
both, so a hot label or a third of all rows in one group is spread over cells.

Comparing every anchor with every row is the task; the vectors that move are one
copy of the candidates per group of anchors and one of the anchors per chunk.

* rows with a null id, null label, null vector or a null or non-finite component take no part.
* repeated ids: the first row in the order of label and components takes part.
* vectors of different lengths: the shorter one is padded with zeros; empty ones score 0.
* ties go to the smaller id; an anchor without positives or window gives no rows.
* scores whose hundredfold does not fit into 64 bits raise an OverflowError.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tiles import TILE, Heaps, finite, matrix, one_per_id, streamed

#: Sides up to this are multiplied directly.
LEAF = 32
#: Anchors of a group and candidates of a chunk, about.
GROUP, CHUNK = 4096, 4096
#: Candidates multiplied at once.
WIDE = 1024
_WORST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Mining:
    """``positives`` and ``negatives`` per anchor and positive; a negative scores from ``low`` to ``high`` hundredths of the positive."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices with seven products of halves for eight."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        # The inner loop runs along both operands' memory.
        return a @ np.ascontiguousarray(b.T).T
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])[:m, :n]


def scaled(column: pa.Array, scale: int) -> np.ndarray:
    """Rows of whole numbers; refuses those whose scores need more than 64 bits."""
    x = np.floor(matrix(column, np.float64) * scale)
    if x.size and float(np.abs(x).max()) ** 2 * max(x.shape[1], 1) * 100 >= 2.0**63:
        raise OverflowError("inner products do not fit into 64 bits")
    return x.astype(np.int64)


def _side(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _tiles(anchors: np.ndarray, rows: np.ndarray):
    """(first anchor, first row, scores) of all tiles of anchors by rows."""
    width = max(anchors.shape[1], rows.shape[1])
    anchors, turned = _side(anchors, width), np.ascontiguousarray(_side(rows, width).T)
    deep = max(TILE // WIDE, 1)
    for at in range(0, rows.shape[0], WIDE):
        for top in range(0, anchors.shape[0], deep):
            yield top, at, strassen(anchors[top : top + deep], turned[:, at : at + WIDE])


def _positives(scale: int, k: int):
    schema = "anchor_id long, positive_id long, positive_score long"

    def run(batches):
        key = ids = vectors = heaps = None

        def done():
            row, score, found = heaps.entries()
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(~score)], ["anchor_id", "positive_id", "positive_score"])

        for (*cell, kind), part in streamed(batches, ["g", "c", "label", "kind"]):
            own, x = part.column("vec_id").to_numpy(), scaled(part.column("v"), scale)
            if cell != key:
                if heaps is not None:
                    yield done()
                key, ids, vectors, heaps = cell, None, None, None
            if kind == 0:
                ids = own if ids is None else np.concatenate([ids, own])
                vectors = x if vectors is None else np.concatenate([_side(vectors, x.shape[1]), _side(x, vectors.shape[1])])
                continue
            if ids is None:
                continue
            heaps = heaps or Heaps(len(ids), k, np.int64, _WORST)
            for top, at, s in _tiles(vectors, x):
                # Better scores are smaller in the heaps: complements turn the order without overflow.
                low = ~s
                good = low < heaps.bound()[top : top + len(s), None]
                good &= ids[top : top + len(s), None] != own[None, at : at + s.shape[1]]
                r, c = np.nonzero(good)
                heaps.offer(r + top, low[r, c], own[at + c])
        if heaps is not None:
            yield done()

    return run, schema


def _windows(scale: int, k: int, low: int, high: int):
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def run(batches):
        key = heaps = None
        held: list[pa.RecordBatch] = []

        def opened():
            """Anchors of the cell, and their positives one below the other."""
            t = pa.Table.from_batches(held)
            lists = t["positives"].combine_chunks()
            flat = lists.flatten()
            owner = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
            score = flat.field("positive_score").to_numpy()
            return (t["vec_id"].to_numpy(), t["label"].to_numpy(), scaled(t["v"].combine_chunks(), scale), owner, flat.field("positive_id").to_numpy(), score,
                    -(-low * score // 100), high * score // 100, Heaps(len(owner), k, np.int64, _WORST))

        def done():
            row, score, found = heaps.entries()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[owner[row]]), pa.array(pos[row]), pa.array(pos_score[row]), pa.array(found), pa.array(~score)],
                ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

        for (*cell, kind), part in streamed(batches, ["g", "c", "kind"]):
            if cell != key:
                if heaps is not None:
                    yield done()
                key, heaps, held = cell, None, []
            if kind == 0:
                held.append(part)
                continue
            if not held:
                continue
            if heaps is None:
                ids, labels, vectors, owner, pos, pos_score, floor, ceiling, heaps = opened()
            own, own_label, x = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), scaled(part.column("v"), scale)
            for top, at, s in _tiles(vectors, x):
                other = labels[top : top + len(s), None] != own_label[None, at : at + s.shape[1]]
                a, b = np.searchsorted(owner, [top, top + len(s)])
                for first in range(a, b, len(s)):
                    rows = np.arange(first, min(first + len(s), b))
                    mine = s[owner[rows] - top]
                    good = other[owner[rows] - top] & (mine >= floor[rows, None]) & (mine <= ceiling[rows, None]) & (~mine < heaps.bound()[rows, None])
                    r, c = np.nonzero(good)
                    heaps.offer(r + first, ~mine[r, c], own[at + c])
        if heaps is not None:
            yield done()

    return run, schema


def _cells(anchors: DataFrame, rows: DataFrame, groups: int, chunks: int, order: list[str]) -> DataFrame:
    """Each group of anchors with each chunk of rows, sorted so that a cell's anchors come first."""
    of = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("g", of(groups, 1)).withColumn("c", every(chunks)).withColumn("kind", F.lit(0))
    r = rows.withColumn("c", of(chunks, 2)).withColumn("g", every(groups)).withColumn("kind", F.lit(1))
    return (a.unionByName(r, allowMissingColumns=True).repartition(groups * chunks, "g", "c")
            .sortWithinPartitions("g", "c", *order, "vec_id"))


def mine(rows: DataFrame, anchor: Column | str, mining: Mining = Mining(), id_col: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
         group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` is the condition for anchors."""
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                      F.col(vector).alias("v"), F.coalesce(F.expr(anchor) if isinstance(anchor, str) else anchor, F.lit(False)).alias("is_anchor"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("v"))
    own = one_per_id(own, "vec_id", ["label", "v", "is_anchor"])
    anchors, all_rows = own.filter("is_anchor").drop("is_anchor"), own.drop("is_anchor")
    sizes = own.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors")).first()
    groups = max(1, -(-sizes["anchors"] // group))
    # More chunks than this would copy more anchors than rows and return more heaps than either.
    chunks = max(1, min(-(-sizes["n"] // chunk), max(64, 20 * groups)))

    run, schema = _positives(mining.scale, mining.positives)
    near = _cells(anchors, all_rows, groups, chunks, ["label", "kind"]).mapInArrow(run, schema)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("_cw_rank", F.row_number().over(best)).filter(F.col("_cw_rank") <= mining.positives)
    lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    ready = cut_lineage(anchors.join(lists, "vec_id"))

    run, schema = _windows(mining.scale, mining.negatives, mining.low, mining.high)
    found = _cells(ready, all_rows, groups, chunks, ["kind"]).mapInArrow(run, schema)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= mining.negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
