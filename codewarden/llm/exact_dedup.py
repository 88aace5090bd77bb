"""Exact deduplication by content-defined chunk recipes.

Texts are equal when they are identical without the six ASCII white-space
characters.  Every normalised text is cut where a rolling hash of its last 32
bytes says so, so equal passages give equal chunks wherever they stand.  A
chunk's identifier is its 64-bit digest plus a variant number: chunk contents
move once, deduplicated in the map tasks, and digests that stand for more than
one content get numbered variants, so equal identifiers mean equal bytes.
Documents are then compared by their ordered identifier lists alone; no text
moves for that, however long it is.

* null text: empty; all empty texts form one group with an empty recipe.
* of a group stays the row with the most code points in its original text, then
  the smallest id (null last); of fully equal rows exactly one stays.
* other columns are kept by `deduplicate`; names of the operator's own columns
  begin with ``_cw_`` and cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import keep_rows, row_key, slices, steps, texts

BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of a chunk: at least, at most, and the mask whose zero bits end one (about 2 KiB more).
LEAST, MOST, MASK = 512, 16384, np.uint32(0x7FF << 21)


def _gear(n: int = 256) -> np.ndarray:
    """One random word per byte value: a fixed mixing of its number."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks of a byte string, in order."""
    if len(data) <= LEAST:
        return [data] if data else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    # Sum of the last 32 words, each shifted by its distance, by doubling.
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    ends = (np.flatnonzero((h & MASK) == 0) + 1).tolist()
    out, at = [], 0
    for end in [*ends, len(data)]:
        while end - at > MOST:
            out.append(data[at : at + MOST])
            at += MOST
        if end - at >= LEAST or end == len(data):
            if end > at:
                out.append(data[at:end])
            at = end
    return out


def _digest(chunk: bytes, bits: int) -> int:
    h = xxhash.xxh64_intdigest(chunk) & ((1 << bits) - 1)
    return h - (1 << 64) if h >> 63 else h


def _recipes(docs: DataFrame, bits: int) -> DataFrame:
    """Add recipe (digests in order) and sha256 of the normalised ``_cw_text``, which goes."""
    kept = [f for f in docs.schema if f.name != "_cw_text"]

    def run(batches):
        for batch in slices(batches):
            recipe, sha = [], []
            for (column,) in steps([batch.select(["_cw_text"])]):
                for raw in column:
                    data = raw.translate(None, BLANKS)
                    recipe.append([_digest(c, bits) for c in chunks(data)])
                    sha.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(recipe, pa.list_(pa.int64())), pa.array(sha, pa.string())],
                [*(f.name for f in kept), "_cw_recipe", "_cw_sha"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{schema}, _cw_recipe array<long>, _cw_sha string")


def _contents(docs: DataFrame, bits: int) -> DataFrame:
    """(sha, pos, digest, content) for every chunk of every ``_cw_text``."""

    def run(batches):
        for batch in slices(batches):
            for (column,) in steps([batch.select(["_cw_text"])], 64):
                sha, pos, digest, content = [], [], [], []
                for raw in column:
                    data = raw.translate(None, BLANKS)
                    name = hashlib.sha256(data).hexdigest()
                    for i, c in enumerate(chunks(data)):
                        sha.append(name)
                        pos.append(i)
                        digest.append(_digest(c, bits))
                        content.append(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sha, pa.string()), pa.array(pos, pa.int32()), pa.array(digest, pa.int64()), pa.array(content, pa.binary())],
                    ["_cw_sha", "_cw_pos", "_cw_digest", "_cw_content"])

    return docs.select("_cw_text").mapInArrow(run, "_cw_sha string, _cw_pos int, _cw_digest long, _cw_content binary")


def _variants(docs: DataFrame, bits: int) -> DataFrame | None:
    """Per text (sha) with an ambiguous digest: its variant numbers in order; None if there is none."""
    parts = _contents(docs, bits)
    clash = cut_lineage(parts.select("_cw_digest", "_cw_content").distinct()
                        .groupBy("_cw_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_cw_digest"))
    if clash.isEmpty():
        return None
    met = parts.join(clash, "_cw_digest")
    # Numbered over distinct contents of one digest: a handful, whatever the number of copies.
    number = F.row_number().over(Window.partitionBy("_cw_digest").orderBy("_cw_content")) - 1
    named = cut_lineage(met.select("_cw_digest", "_cw_content").distinct().withColumn("_cw_variant", number))
    return (met.distinct().join(named, ["_cw_digest", "_cw_content"])
            .groupBy("_cw_sha").agg(F.array_sort(F.collect_list(F.struct("_cw_pos", "_cw_variant"))).alias("_cw_fix")))


def recipes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest_bits: int = 64) -> DataFrame:
    """One row per document with its group: who stays, group size, whether this row stays.

    ``digest_bits`` shortens the chunk digests; a test uses it to meet collisions.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(F.length(F.col(text)), F.lit(0)).alias("_cw_cp"),
                    row_key(id_col, text).alias("_cw_key"), texts(text).alias("_cw_text"))
    slim = _recipes(d, digest_bits)
    fixes = _variants(d, digest_bits)
    if fixes is None:
        slim = slim.withColumn("_cw_fix", F.expr("cast(array() as array<struct<_cw_pos: int, _cw_variant: int>>)"))
    else:
        slim = slim.join(fixes, "_cw_sha", "left").withColumn(
            "_cw_fix", F.coalesce("_cw_fix", F.expr("cast(array() as array<struct<_cw_pos: int, _cw_variant: int>>)")))
    slim = cut_lineage(slim.withColumn("_cw_row", F.monotonically_increasing_id()))
    same = ["_cw_recipe", "_cw_fix"]
    best = F.max(F.struct("_cw_cp", F.bitwise_not("doc_id").alias("_cw_low"), (-F.col("_cw_row")).alias("_cw_row")))
    groups = cut_lineage(slim.groupBy(*same).agg(F.count(F.lit(1)).alias("_cw_n"), best.alias("_cw_best"))
                         .filter("_cw_n > 1"))
    # The other rows stand alone; a written right side lets Spark split a hot recipe.
    keep = F.coalesce(F.col("_cw_row") == -F.col("_cw_best._cw_row"), F.lit(True))
    return (slim.join(groups, same, "left")
            .select("doc_id", F.when(F.col("_cw_n").isNull(), F.col("doc_id")).otherwise(F.bitwise_not("_cw_best._cw_low")).alias("keep_id"),
                    F.coalesce("_cw_n", F.lit(1)).cast("long").alias("group_size"), keep.alias("kept"),
                    F.col("_cw_sha").alias("text_sha256"), "_cw_key"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = recipes(docs, id_col, text).filter("kept").select("_cw_key")
    return keep_rows(docs, stay, id_col, text)
