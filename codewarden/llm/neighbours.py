"""Approximate nearest neighbours by cross-polytope hashing.

Vectors of unit length are turned by pseudo-rotations - random signs, then a fast
Hadamard transform, three times - and hashed to the signed axis they lie nearest
to.  Every table has rotations of its own; a row is in one bucket of each.  A
query probes the buckets of a table in the order of how little its turned vector
falls short of their axes.  The rows of the probed buckets are its candidates, and
their distances are computed exactly on the original vectors.

How many buckets are probed, and whether a bucket is named by one axis or by two,
is set by a bounded sample of queries (``Search.sample``): their exact neighbours
are found among all rows, and the fewest probes are taken that reach
``Search.recall`` of them.  All rows are indexed and all queries are answered.

Queries move to buckets, rows to one bucket a table.  A bucket with many rows
becomes a grid of query groups and row chunks.  Of equal vectors only the ``k + 1``
smallest ids can be among anyone's nearest, and equal queries are answered once,
so a vector that a third of all rows share stays cheap.

* rows with a null id and vectors that are null, empty, zero or hold null or non-finite components take no part.
* repeated ids: the first row in the order of components takes part.
* only vectors of the query's own length are its neighbours.
* ties go to the smaller id; a query with fewer candidates has fewer rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shingles import mix
from .tiles import Heaps, finite, matrix, one_per_id, streamed

#: Queries of a group and rows of a chunk, about.
GROUP, CHUNK = 4096, 4096
#: Queries and rows compared at once.
DEEP, WIDE = 256, 1024
#: Large buckets are told to the tasks by broadcast up to this many, else by a join.
TOLD = 100_000
_ROUNDS = 3


@dataclass(frozen=True)
class Search:
    """``k`` nearest; ``tables``; the ``recall`` to reach on ``sample`` queries; copies of the rows that probes may cost at most."""

    k: int = 10
    tables: int = 2
    recall: float = 0.95
    sample: int = 128
    copies: float = 4.0


@dataclass(frozen=True)
class Probes:
    """``axes`` that name a bucket, and buckets probed in each table."""

    axes: int
    count: int


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pair = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x


def turned(x: np.ndarray, rotation: int) -> np.ndarray:
    """Signed coordinates of unit vectors after one pseudo-rotation: (rows, 2 x padded width)."""
    width = 1 << max(x.shape[1] - 1, 0).bit_length()
    y = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for r in range(_ROUNDS):
        bits = mix(np.arange(width, dtype=np.uint64) + np.uint64((rotation * _ROUNDS + r + 1) << 32)) >> np.uint64(63)
        y = hadamard(y * np.where(bits, -1.0, 1.0)) / np.sqrt(width)
    return np.concatenate([y, -y], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def buckets(x: np.ndarray, tables: int, axes: int) -> np.ndarray:
    """(rows, tables): the bucket of every row in each table."""
    out = np.empty((len(x), tables), np.int64)
    for t in range(tables):
        name = np.full(len(x), t, np.int64)
        for a in range(axes):
            signed = turned(x, t * 2 + a)
            name = name * signed.shape[1] + signed.argmax(axis=1)
        out[:, t] = name
    return out


def _gaps(x: np.ndarray, table: int, axes: int) -> list[np.ndarray]:
    """How far each signed coordinate falls short of the largest one, for every axis of a bucket's name."""
    out = []
    for a in range(axes):
        signed = turned(x, table * 2 + a)
        out.append(signed.max(axis=1, keepdims=True) - signed)
    return out


def probed(x: np.ndarray, tables: int, probes: Probes) -> list[np.ndarray]:
    """Buckets that each row probes, best first, over all tables."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(x))]
    for t in range(tables):
        gaps = _gaps(x, t, probes.axes)
        width = gaps[0].shape[1]
        order = [np.argsort(g, axis=1, kind="stable") for g in gaps]
        if probes.axes == 1:
            for i, o in enumerate(order[0][:, : probes.count]):
                found[i].append(t * width + o)
            continue
        # The first ``count`` sums of two sorted lists lie where the product of places is at most that.
        a, b = np.nonzero(np.outer(np.arange(1, width + 1), np.arange(1, width + 1)) <= probes.count)
        for i in range(len(x)):
            one, two = order[0][i], order[1][i]
            total = gaps[0][i][one[a]] + gaps[1][i][two[b]]
            best = np.argsort(total, kind="stable")[: probes.count]
            found[i].append((t * width + one[a[best]]) * width + two[b[best]])
    return [np.concatenate(f) for f in found]


def places(query: np.ndarray, x: np.ndarray, tables: int, axes: int) -> np.ndarray:
    """For one query, the probes it takes to reach each row's bucket in its best table."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    named = buckets(x, tables, axes)
    for t in range(tables):
        gaps = [g[0] for g in _gaps(query[None], t, axes)]
        width = len(gaps[0])
        if axes == 1:
            rank = np.argsort(np.argsort(gaps[0], kind="stable"))[named[:, t] % width] + 1
        else:
            total = gaps[0][named[:, t] // width % width] + gaps[1][named[:, t] % width]
            line = np.sort(gaps[1])
            rank = np.array([np.searchsorted(line, s - gaps[0], side="right").sum() for s in total], np.int64)
        best = np.minimum(best, rank)
    return best


def _nearest(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, heaps: Heaps) -> None:
    """Offer the rows to the queries' heaps; sums of products choose, differences decide."""
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    for at in range(0, len(x), WIDE):
        part, norm = x[at : at + WIDE], xx[at : at + WIDE]
        for top in range(0, len(q), DEEP):
            mine = slice(top, top + DEEP)
            rough = qq[mine, None] + norm - 2 * (q[mine] @ part.T)
            bound = heaps.bound()[mine] ** 2
            if len(part) > heaps.k:
                bound = np.minimum(bound, np.partition(rough, heaps.k - 1, axis=1)[:, heaps.k - 1])
            # Well above the error of the products.
            r, c = np.nonzero(rough <= (bound + 1e-11 * (qq[mine] + norm.max()))[:, None])
            for step in range(0, len(r), 1 << 14):
                a, b = r[step : step + (1 << 14)], c[step : step + (1 << 14)]
                d = q[top + a] - part[b]
                heaps.offer(a + top, np.sqrt((d * d).sum(axis=1)), ids[at + b])


def _exact(rows: DataFrame, sample: list[tuple[int, list[float]]], search: Search) -> list[tuple[int, int]]:
    """For the sample's exact neighbours: probes needed with buckets of one axis and of two."""
    ids = np.array([i for i, _ in sample], np.int64)
    vectors = [np.array(v, np.float64) for _, v in sample]

    def run(batches):
        heaps = {n: Heaps(sum(len(v) == n for v in vectors), search.k + 1, np.float64, np.inf) for n in {len(v) for v in vectors}}
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            size = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for n, heap in heaps.items():
                part = batch.filter(pa.array(size == n))
                if part.num_rows:
                    x, own = matrix(part.column("v"), np.float64), part.column("vec_id").to_numpy()
                    _nearest(np.stack([v for v in vectors if len(v) == n]), ids, x, own, heap)
                    held = set(np.concatenate([h.entries()[2] for h in heaps.values()]).tolist())
                    kept.update({int(i): v for i, v in zip(own, x) if int(i) in held})
                    kept = {i: v for i, v in kept.items() if i in held}
        for n, heap in heaps.items():
            some = [i for i, v in enumerate(vectors) if len(v) == n]
            row, score, found = heap.entries()
            for r in np.unique(row):
                use = row == r
                x = np.stack([kept[int(i)] for i in found[use]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(use.sum(), ids[some[r]])), pa.array(score[use]), pa.array(found[use]),
                     *(pa.array(places(unit(vectors[some[r]][None])[0], unit(x), search.tables, a)) for a in (1, 2))], ["query_id", "score", "vec_id", "one", "two"])

    found = rows.select("vec_id", "v").mapInArrow(run, "query_id long, score double, vec_id long, one long, two long").filter("query_id <> vec_id")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= search.k).select("one", "two")
    return [(r["one"], r["two"]) for r in top.collect()]


def fit(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, search: Search) -> Probes:
    """Probes that reach the recall on the sampled queries; at most ``sample`` of them and their ``k`` neighbours reach the driver."""
    picked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(search.sample).collect()
    sample = [(r["vec_id"], list(r["v"])) for r in picked]
    needed = _exact(rows, sample, search) if sample else []
    if not needed:
        return Probes(1, 1)
    share = lambda k: int(np.quantile([x[k] for x in needed], search.recall, method="higher"))
    width = 2 << max(max(len(v) for _, v in sample) - 1, 0).bit_length()
    one, two = share(0), share(1)
    affordable = two * search.tables * n_queries <= search.copies * n_rows
    return Probes(2, two) if affordable and two / width < one else Probes(1, one)


def _hashed(rows: DataFrame, search: Search, probes: Probes, as_query: bool) -> DataFrame:
    """(vec_id, v, dim, names): the buckets a row is in, or those a query probes."""
    vector = rows.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DEEP):
                part = batch.slice(at, DEEP)
                size = pc.list_value_length(part.column("v")).to_numpy(zero_copy_only=False)
                for n in np.unique(size):
                    own = part.filter(pa.array(size == n))
                    x = unit(matrix(own.column("v"), np.float64))
                    names = probed(x, search.tables, probes) if as_query else list(buckets(x, search.tables, probes.axes))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("vec_id"), own.column("v"), pa.array(np.full(len(x), n, np.int32)), pa.array(names, pa.list_(pa.int64()))], ["vec_id", "v", "dim", "names"])

    return rows.select("vec_id", "v").mapInArrow(run, f"vec_id long, v {vector}, dim int, names array<long>")


def _compare(k: int):
    def run(batches):
        key = ids = q = heaps = None

        def done():
            row, score, found = heaps.entries()
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

        for (*cell, kind), part in streamed(batches, ["dim", "bucket", "g", "c", "kind"]):
            if cell != key:
                if heaps is not None:
                    yield done()
                key, ids, q, heaps = cell, None, None, None
            own, x = part.column("vec_id").to_numpy(), matrix(part.column("v"), np.float64)
            if kind == 0:
                ids, q = (own, x) if ids is None else (np.concatenate([ids, own]), np.concatenate([q, x]))
            elif ids is not None:
                heaps = heaps or Heaps(len(ids), k, np.float64, np.inf)
                _nearest(q, ids, x, own, heaps)
        if heaps is not None:
            yield done()

    return run


def _fewer_copies(rows: DataFrame, most: int) -> DataFrame:
    """Of equal vectors the rows with the smallest ids."""
    digest = F.xxhash64("v")
    many = cut_lineage(rows.groupBy(digest.alias("h")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("h"))
    if many.isEmpty():
        return rows
    own = rows.withColumn("h", digest)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    met = own.join(many, "h", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= most)
    return own.join(many, "h", "left_anti").unionByName(met.drop("rank")).drop("h")


def _spread(entries: DataFrame, big: DataFrame, told: bool, kind: int) -> DataFrame:
    """Put entries into the cells of their bucket's grid."""
    of = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    met = entries.join(F.broadcast(big) if told else big, ["dim", "bucket"], "left").fillna(1, ["groups", "chunks"])
    met = met.withColumn("g", of("groups", 1)).withColumn("c", every("chunks")) if kind == 0 else met.withColumn("c", of("chunks", 2)).withColumn("g", every("groups"))
    return met.withColumn("kind", F.lit(kind)).drop("groups", "chunks")


def search(rows: DataFrame, query: Column | str, how: Search = Search(), id_col: str = "vec_id", vector: str = "embedding", probes: Probes | None = None,
           group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row for which ``query`` holds."""
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"),
                      F.coalesce(F.expr(query) if isinstance(query, str) else query, F.lit(False)).alias("is_query"))
    own = own.filter(F.col("vec_id").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0))
    own = one_per_id(own, "vec_id", ["v", "is_query"])
    n_rows, n_queries = own.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    asked = own.filter("is_query").select("vec_id", "v")
    one = cut_lineage(asked.groupBy("v").agg(F.min("vec_id").alias("vec_id")))
    fewer = _fewer_copies(own.drop("is_query"), how.k + 1)
    probes = probes or fit(fewer, one, n_rows, n_queries, how)

    entry = lambda d: d.select("vec_id", "v", "dim", F.explode("names").alias("bucket"))
    hashed = cut_lineage(_hashed(fewer, how, probes, False))
    asking = cut_lineage(_hashed(one, how, probes, True))
    count = lambda d, name: entry(d).groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias(name))
    grid = count(hashed, "n").join(count(asking, "q"), ["dim", "bucket"]).select("dim", "bucket", F.ceil(F.col("q") / group).alias("groups"), F.ceil(F.col("n") / chunk).alias("chunks"))
    grid = grid.withColumn("chunks", F.least("chunks", F.greatest(F.lit(64), 20 * F.col("groups"))))
    big = cut_lineage(grid.filter("groups > 1 OR chunks > 1"))
    told = big.count() <= TOLD
    cells = _spread(entry(asking), big, told, 0).unionByName(_spread(entry(hashed), big, told, 1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), how.tables * n_rows // (16 * chunk))
    at = ["dim", "bucket", "g", "c"]
    found = (cells.repartition(parts, *at).sortWithinPartitions(*at, "kind", "vec_id")
             .mapInArrow(_compare(how.k + 1), "query_id long, vec_id long, score double"))
    # Tables find the same row again; its score is the same.
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= how.k + 1)
    answers = cut_lineage(near.select(F.col("query_id").alias("one_id"), "vec_id", "score"))
    mine = asked.withColumnRenamed("vec_id", "query_id").join(one.withColumnRenamed("vec_id", "one_id"), "v").select("query_id", "one_id")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (mine.join(answers, "one_id").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score"))
