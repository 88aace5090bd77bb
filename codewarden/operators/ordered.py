"""Order-sensitive building blocks that never put a whole group in one task.

A window function partitioned by a session or a repository moves that whole
group to one task.  The helpers here cut every ordered group into *blocks* of
consecutive positions first, do the heavy work per (group, block), and carry
a one-row-per-block summary across the borders.  The summary table is smaller
than the data by the block size, so the second, per-group window is tiny even
when one group holds most of the rows.

The first order column is an integer position (a line number, an index).  It
need not be dense; a sparse position only makes blocks smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
#: Offsets that are sent to every task: as many rows at most, else rows are shuffled to them.
FEW = 1 << 14


def _block(pos: str, size: int) -> Column:
    return F.floor(F.col(pos) / size)


def _blocked(df: DataFrame, keys: list[str], pos: str, size: int) -> DataFrame:
    """Rows with their block; those without a group or a position have no place.

    A first block takes nothing from others, so the joins below bring only what
    crosses a border: small groups add nothing to them.
    """
    return df.withColumn("_b", _block(pos, size)).dropna(subset=[*keys, "_b"])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                size: int = BLOCK) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows of the group up to this one."""
    d = _blocked(df, keys, order[0], size).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = (d.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
            .withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0)))
            .drop("_t").filter("_base <> 0"))
    return (d.withColumn("_in", F.sum("_v").over(inside))
            .join(base, [*keys, "_b"], "left")
            .withColumn(out, F.col("_in") + F.coalesce("_base", F.lit(0)))
            .drop("_b", "_v", "_in", "_base"))


def neighbour(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
              forward: bool = False, size: int = BLOCK) -> DataFrame:
    """Add ``out`` = nearest earlier (or later) non-null ``value`` in the group."""
    d = _blocked(df, keys, order[0], size).withColumn("_v", value)
    nearest = F.first if forward else F.last
    span = (1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(*span)
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(*span)
    # Rows without a value have no place in the order: one pass, and a block of such rows stays.
    edge = (F.min_by if forward else F.max_by)("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    carry = (d.groupBy(*keys, "_b").agg(edge.alias("_edge"))
             .withColumn("_carry", nearest("_edge", ignorenulls=True).over(across)).drop("_edge").filter("_carry is not null"))
    return (d.withColumn("_in", nearest("_v", ignorenulls=True).over(inside))
            .join(carry, [*keys, "_b"], "left")
            .withColumn(out, F.coalesce("_in", "_carry"))
            .drop("_b", "_v", "_in", "_carry"))


def row_positions(df: DataFrame, keys: list[str], order: list[Column], out: str, without: list[str] | None = None) -> DataFrame:
    """Dense 1-based position of every row in its group, without a group window.

    Rows are range-partitioned on (group, order), so a large group is spread
    over many partitions; they are sorted there and numbered as they are written,
    and a table with one row per (group, partition) supplies the offsets.  Rows move
    once where that table is small, and once more to meet it where groups are many.
    ``without`` names columns that only the order needs; they are not written.
    """
    from ..session import cut_lineage

    by = [*[F.col(k) for k in keys], *order]
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    # Cut here: a recomputed range partitioning may choose other borders.
    placed = cut_lineage(ordered.drop(*(without or []))).withColumn("_slice", F.shiftright("_row", 33))
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = cut_lineage(placed.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
                       .withColumn("_base", F.coalesce(F.sum("_n").over(across), F.lit(0)) - F.col("_first") + 1).drop("_n", "_first"))
    few = base.limit(FEW + 1).count() <= FEW
    return (placed.join(F.broadcast(base) if few else base.hint("merge"), [*keys, "_slice"])
            .withColumn(out, F.col("_row") + F.col("_base"))
            .drop("_slice", "_row", "_base"))


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows of each group; Spark limits every map task to ``k`` first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def ordered_union(df: DataFrame, keys: list[str], items: Column, order: Column, out: str) -> DataFrame:
    """Union of the arrays of a group, elements by first appearance.

    Elements are pre-aggregated per (group, element) with a map-side combine,
    so the final list holds distinct elements only, however many rows there are.
    """
    flat = df.select(*keys, order.alias("_o"), F.posexplode(items).alias("_p", "_e"))
    firsts = flat.groupBy(*keys, "_e").agg(F.min(F.struct("_o", "_p")).alias("_f"))
    return firsts.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_f", "_e"))), lambda x: x["_e"]).alias(out))
