"""Mixing sources to target weights by Pfair block scheduling.

Every source is put into a fixed pseudo-random order and cut into blocks of
``block`` characters, longer ones where the corpus would have more than ``MOST``.  With target weight w, block i (from 1) of a source may
start at slot floor((i - 1) / w) and has to be done by slot ceil(i / w); in each
slot the released block with the earliest deadline goes next.  With weights that
add up to one this meets all deadlines, so after any number of slots a source is
less than one block away from its share.

Windows follow the exact weights: a float is a whole number of some power of
two, so all of them become integers and nothing is rounded.  The driver works
out the slot of every block from the table of sources (one row each) and sends
it out in pieces of bounded length.  When a source runs out, a new phase begins
with the weights of the others; ``phase`` 0 is the part that has the target mix,
later phases hold what is left, so that no row is lost.

* null source: a source of its own; it is named "" like an empty one.
* null text counts as one character, like an empty one.
* a source without a target, or with target 0, follows after all the others, by size.
* rows equal in id and text share a place; all of them stay.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import row_key

BLOCK = 1 << 16
#: Slots in a row of the plan at most.
PIECE = 1 << 12
#: Blocks of the whole corpus, about: the driver holds a few numbers for each.
MOST = 1 << 20


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the same proportion."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def schedule(weights: dict[str, int], left: dict[str, int]) -> dict[str, list[int]]:
    """Slots of the blocks of each source until the first one has no blocks left, earliest deadline first."""
    total = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in sorted(weights)]
    ready: list[tuple[int, str]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        t += 1
        if len(slots[s]) == left[s]:
            return slots
        heapq.heappush(waiting, (len(slots[s]) * total // weights[s], s))


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[tuple]:
    """Rows (source, phase, first block, end block, first slot, length, slots) of the whole schedule.

    A row holds up to ``PIECE`` blocks; ``slots`` count from the first slot of
    the phase, ``length`` is that of the phase.
    """
    left, done, at, rows, phase = dict(blocks), dict.fromkeys(blocks, 0), 0, [], 0
    left = {s: n for s, n in left.items() if n}
    while left:
        wanted = {s: weights[s] for s in left if weights.get(s, 0) > 0}
        now = wanted or {s: blocks[s] for s in left}
        slots = schedule(whole(now), left)
        span = sum(map(len, slots.values()))
        for s in sorted(now):
            for k in range(0, len(slots[s]), PIECE):
                piece = slots[s][k : k + PIECE]
                rows.append((s, phase, done[s] + k, done[s] + k + len(piece), at, span, piece))
            done[s] += len(slots[s])
            left[s] -= len(slots[s])
        left = {s: n for s, n in left.items() if n}
        at, phase = at + span, phase + 1
    return rows


PLAN = "_cw_source string, phase int, _cw_from long, _cw_to long, _cw_at long, _cw_span long, _cw_slots array<long>"


def places(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, block: int = BLOCK,
           most: int = MOST, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(_cw_key, phase, slot, block, offset) for every distinct row; ``offset`` is its start in its source.

    Without ``weights`` a source weighs its number of characters to the power ``temper``.
    Blocks have ``block`` characters, or one ``most``-th of the corpus where that is more.
    """
    size = F.greatest(F.coalesce(F.length(F.col(text)), F.lit(1)), F.lit(1)).cast("long")
    slim = (docs.select(row_key(id_col, text).alias("_cw_key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_cw_source"), size.alias("n"))
            .groupBy("_cw_key", "_cw_source").agg(F.sum("n").alias("n")))
    # The key is a digest, so its order is a fixed shuffle.  Written: another run may cut the ranges elsewhere.
    placed = cut_lineage(slim.repartitionByRange("_cw_source", "_cw_key").withColumn("_cw_slice", F.spark_partition_id()))
    inside = Window.partitionBy("_cw_source", "_cw_slice").orderBy("_cw_key").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_cw_source").orderBy("_cw_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and slice: sums before each slice, and the sources' totals.
    sums = placed.groupBy("_cw_source", "_cw_slice").agg(F.sum("n").alias("_cw_sum"))
    base = sums.withColumn("_cw_base", F.coalesce(F.sum("_cw_sum").over(across), F.lit(0))).drop("_cw_sum")
    totals = {r["_cw_source"]: r["n"] for r in sums.groupBy("_cw_source").agg(F.sum("_cw_sum").alias("n")).collect()}
    block = max(block, -(-sum(totals.values()) // most))
    blocks = {s: (n - 1) // block + 1 for s, n in totals.items()}
    rows = phases(blocks, weights if weights is not None else {s: n**temper for s, n in totals.items()})
    # One row per block; the join is by source and block, so that no source is a hot key.
    plan = (docs.sparkSession.createDataFrame(rows, PLAN)
            .select("_cw_source", "phase", "_cw_from", "_cw_at", F.posexplode("_cw_slots").alias("_cw_i", "_cw_slot"))
            .select("_cw_source", "phase", (F.col("_cw_from") + F.col("_cw_i")).alias("block"), (F.col("_cw_at") + F.col("_cw_slot")).alias("slot")))
    offset = F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("_cw_base")
    return (placed.join(base, ["_cw_source", "_cw_slice"]).withColumn("offset", offset)
            .withColumn("block", F.floor(F.col("offset") / block))
            .join(plan, ["_cw_source", "block"])
            .select("_cw_key", "_cw_source", "phase", "slot", "block", "offset"))


def _placed(docs: DataFrame, id_col: str, text: str, source: str, options: dict) -> DataFrame:
    place = cut_lineage(places(docs, id_col=id_col, text=text, source=source, **options))
    place = place.select("_cw_key", "_cw_source", *[F.col(c).alias(f"_cw_{c}") for c in PLACE])
    return (docs.withColumn("_cw_key", row_key(id_col, text)).withColumn("_cw_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
            .join(place, ["_cw_key", "_cw_source"]))


PLACE = ("phase", "slot", "block", "offset")


def located(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """All rows of ``docs`` with their place; own columns of these names are replaced."""
    own = [c for c in docs.columns if c not in PLACE]
    return _placed(docs, id_col, text, source, options).select(*own, *[F.col(f"_cw_{c}").alias(c) for c in PLACE])


def interleaved(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """All rows of ``docs`` with their own columns, sorted into the mixed order."""
    return _placed(docs, id_col, text, source, options).orderBy("_cw_slot", "_cw_offset", "_cw_key").select(*docs.columns)
