"""Substring deduplication by hashing normalised lines and sentences.

Texts are cut at line breaks and after [.!?] before a blank.  A unit begins at
every piece that has words and takes as many whole pieces as it needs to reach
``least`` words; another ends at every piece and reaches back as far as needed.
So whatever whole pieces two places have in common is found to both ends if it
has ``least`` words; short pieces alone - headings, list items, signatures - are
left as they are.  Units are normalised
(compatibility forms, case, white space) and grouped by digest over the whole
corpus.  The occurrence with the earliest rank - smallest id (null last), then
row digest, then position - stays; the others are removed.  Spans are code
points of the original text, end exclusive, and cover whole pieces with the blanks after them.

The texts are read twice.  The first pass counts digests and takes the smallest
id of each; only digests met twice are written.  The second pass makes the units
anew and keeps those in that table, so a unit that nobody shares is never written.

* null text: empty, no units.
* rows equal in id and text count as one document: they are treated alike.
* a repeat inside one document is removed like one across documents.
* ids are whole numbers; others count as null.
* other columns are kept by `clean`.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import decoded, runs, slices, texts
from .shingles import mix

#: Words of a unit at least.
LEAST = 20
#: Pieces end with a line break, or with the blanks after the end of a sentence.
_END = re.compile(r"\n|(?<=[.!?])[^\S\n]+\n?")
SPANS = "array<struct<start: int, end: int>>"
_NO_ID = (1 << 63) - 1
#: Odd factors by which the digests of a unit's pieces are weighted, one for each lane, and their inverses.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(f, -1, 1 << 64) for f in _FACTORS)


def _powers(factor: int, n: int) -> np.ndarray:
    x = np.full(n, factor, np.uint64)
    x[:1] = 1
    return np.cumprod(x, dtype=np.uint64)


def units(texts_: list[str], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Units of several texts: number of the text, digest (64 and 32 bits), start and end, by text and start; the end takes in the break.

    A unit's digest is a polynomial in the digests of its pieces, so that every
    piece is hashed once however many units it is part of.
    """
    starts, ends, count, digests, border = [], [], [0], [], [0]
    for text in texts_:
        cuts = [m.end() for m in _END.finditer(text)]
        plain = unicodedata.is_normalized("NFKC", text)
        at = 0
        for end in [*cuts, len(text)]:
            piece = text[at:end]
            words = (piece if plain else unicodedata.normalize("NFKC", piece)).casefold().split()
            if words:
                starts.append(at)
                ends.append(end)
                count.append(len(words))
                digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace")))
            at = end
        border.append(len(starts))
    n, total, border = len(starts), np.cumsum(np.array(count, np.int64)), np.array(border, np.int64)
    text_of = np.repeat(np.arange(len(texts_)), np.diff(border))
    # Pieces i to j of one text: the shortest runs of enough words that begin at i, and those that end at j.
    i = np.arange(n)
    j = np.searchsorted(total, total[:-1] + least)
    ahead = (i * (n + 1) + j)[j <= border[1:][text_of]]
    j = np.arange(1, n + 1)
    i = np.searchsorted(total, total[1:] - least, side="right") - 1
    back = (i * (n + 1) + j)[i >= border[:-1][text_of]]
    found = np.unique(np.concatenate([ahead, back])).astype(np.int64)
    i, j = found // (n + 1), found % (n + 1)
    cells = np.frombuffer(b"".join(digests), np.uint64).reshape(n, 2)
    lanes = []
    for lane in range(2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(cells[:, lane] * _powers(_FACTORS[lane], n))])
        lanes.append(mix((sums[j] - sums[i]) * _powers(_INVERSES[lane], n)[i] + (j - i).astype(np.uint64)))
    return (text_of[i], lanes[0].view(np.int64), (lanes[1] >> np.uint64(32)).astype(np.uint32).view(np.int32),
            np.array(starts, np.int64)[i], np.array(ends, np.int64)[j - 1])


def _key(id_col: str, text: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.col(id_col).cast("string"), texts(text))


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).try_cast("long"), F.lit(_NO_ID))


def _first_here(own: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first occurrence of each digest in each text, and how many there are."""
    order = np.lexsort((lo, own))
    new = np.ones(len(order), bool)
    new[1:] = (own[order][1:] != own[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    return order[new], np.diff(np.append(np.flatnonzero(new), len(order)))


def _digests(docs: DataFrame, least: int) -> DataFrame:
    """(lo, hi, doc, n): each digest of each document once."""

    def run(batches):
        for batch in slices(batches, 64):
            own, lo, hi, _, _ = units([decoded(raw) for raw in batch.column("_cw_text").to_pylist()], least)
            first, n = _first_here(own, lo)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lo[first], hi[first], batch.column("doc").to_numpy()[own[first]], n)], ["lo", "hi", "doc", "n"])

    return docs.select("doc", "_cw_text").mapInArrow(run, "lo long, hi int, doc long, n long")


def _units(docs: DataFrame, least: int) -> DataFrame:
    """(lo, hi, doc, key, span, again): all units, and whether the digest stands in the same text before."""

    def run(batches):
        for batch in slices(batches, 64):
            own, lo, hi, start, end = units([decoded(raw) for raw in batch.column("_cw_text").to_pylist()], least)
            again = np.ones(len(lo), bool)
            again[_first_here(own, lo)[0]] = False
            named = [batch.column(c).to_numpy()[own] for c in ("doc", "key")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lo, hi, *named, start << 32 | end, again)], ["lo", "hi", "doc", "key", "span", "again"])

    return docs.mapInArrow(run, "lo long, hi int, doc long, key long, span long, again boolean")


def _merge(rows: DataFrame) -> DataFrame:
    """Spans of a document without overlaps, from rows sorted by (doc, key, span)."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for group in runs(batches, ["doc", "key"]):
            spans: list[list[int]] = []
            for span in group["span"].to_pylist():
                a, b = span >> 32, span & 0xFFFFFFFF
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            first = sorted(set(group["first"].to_pylist()) - {_NO_ID})
            yield pa.RecordBatch.from_arrays(
                [*(group[k].chunk(0).slice(0, 1) for k in ("doc", "key")), pa.array([[{"start": a, "end": b} for a, b in spans]], kind),
                 pa.array([first], pa.list_(pa.int64()))], ["doc", "key", "removed", "first_ids"])

    return (rows.repartition("doc", "key").sortWithinPartitions("doc", "key", "span")
            .mapInArrow(run, f"doc long, key long, removed {SPANS}, first_ids array<long>"))


def repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, key, removed spans, ids of the documents that keep the passages) per document that loses something."""
    d = docs.select(_doc(id_col).alias("doc"), _key(id_col, text).alias("key"), texts(text).alias("_cw_text"))
    # Copies meet in the map tasks first; the written table lets Spark split a hot digest in the join.
    first = _digests(d, least).groupBy("lo", "hi").agg(F.min("doc").alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    found = _units(d, least)
    # Rows of one id with different texts are ranked by their digests.
    several = cut_lineage(d.groupBy("doc").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("doc"))
    if several.isEmpty():
        first = first.withColumn("first_key", F.lit(None).cast("long"))
    else:
        low = found.join(several, "doc", "left_semi").groupBy("lo", "hi", F.col("doc").alias("first")).agg(F.min("key").alias("first_key"))
        first = cut_lineage(first).join(low, ["lo", "hi", "first"], "left")
    later = (F.col("doc") != F.col("first")) | F.col("again") | F.coalesce(F.col("key") != F.col("first_key"), F.lit(False))
    return _merge(found.join(cut_lineage(first), ["lo", "hi"]).filter(later).select("doc", "key", "span", "first"))


def _cut(rows: DataFrame, text: str) -> DataFrame:
    """Replace the text by what stays and add the kept spans."""
    fields = rows.schema.fields

    def run(batches):
        for batch in slices(batches):
            out, spans = [], []
            for raw, gone in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("removed").to_pylist()):
                if not gone:
                    out.append(None if raw is None else decoded(raw))
                    spans.append([] if not raw else [{"start": 0, "end": len(out[-1])}])
                    continue
                body, at, kept = decoded(raw), 0, []
                for s in [*gone, {"start": len(body), "end": len(body)}]:
                    if s["start"] > at:
                        kept.append({"start": at, "end": s["start"]})
                    at = s["end"]
                out.append("".join(body[k["start"] : k["end"]] for k in kept))
                spans.append(kept)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            cols = [pa.array(out, pa.string()) if f.name == text else batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], [*(f.name for f in fields), "kept"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", kept {SPANS}")


def clean(docs: DataFrame, least: int = LEAST, changed_only: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shortened texts, and per row: removed and kept spans of the
    original text and the ids that keep its removed passages."""
    own = docs.select(*[c for c in docs.columns if c not in ("removed", "kept", "first_ids")])
    gone = cut_lineage(repeats(docs, least, id_col, text)).withColumnsRenamed({"doc": "_cw_doc", "key": "_cw_key"})
    own = own.withColumn("_cw_doc", _doc(id_col)).withColumn("_cw_key", _key(id_col, text))
    return _cut(own.join(gone, ["_cw_doc", "_cw_key"], "inner" if changed_only else "left").drop("_cw_doc", "_cw_key"), text)
