"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time inside an Arrow batch.
STEP = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(name: str = "text") -> Column:
    """A text column as bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def row_key(id_col: str, text: str) -> Column:
    """Identity of a row by id and original text."""
    return F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), texts(text)), 256)


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose `row_key` is in ``keys`` (column ``_cw_key``, distinct); one of rows equal in id and text."""
    rest = [c for c in docs.columns if c not in (id_col, text)]
    first = F.row_number().over(Window.partitionBy("_cw_key").orderBy(F.xxhash64(F.lit(0), *rest)))
    return (docs.withColumn("_cw_key", row_key(id_col, text)).join(keys, "_cw_key")
            .withColumn("_cw_first", first).filter("_cw_first = 1").select(*docs.columns))


def slices(batches: Iterable[pa.RecordBatch], step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces of a bounded number of rows, for results of about the input's size."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def steps(batches: Iterable[pa.RecordBatch], step: int = STEP) -> Iterator[list[list]]:
    """Columns of Arrow batches as Python lists, a bounded number of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield [c.to_pylist() for c in batch.slice(at, step).columns]


def decoded(raw: bytes) -> str:
    """Text of a string column; bytes that are no UTF-8 become U+FFFD."""
    return raw.decode("utf-8", "replace")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal keys from batches sorted by these keys.

    Only one group is held at a time, also where it spans several batches.
    Keys are columns without nulls.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a].as_py() for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
