"""Report documents: nested JSON as ordered lines, and a sink with a commit.

A document is a sorted stream of lines.  Each line carries its place - section,
item, sub-item - so a document of any size is never put together in one row:
the opening of an item, its children and its closing are lines of their own.
The sink streams the lines of a document into one file, in one task, and makes
all files visible together when every task has succeeded.  They stay lines in
the file, so a reader can split a document, too: `read_flat`.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .exports import SCHEMA as SARIF_SCHEMA
from .exports import VERSION, results, rules
from .traces import read_lines

PLACE = ["section", "item", "sub"]
_LAST = (1 << 62)


@dataclass(frozen=True)
class Section:
    """An array of the document: rows (key, item, body) with a JSON object each, by ``item``.

    ``children`` are rows (key, item, sub, body); they become an array ``child``
    inside the object of their item.  Every item with children is in ``rows``.
    """

    name: str
    rows: DataFrame
    child: str | None = None
    children: DataFrame | None = None


def _comma(first: Column, text: Column) -> Column:
    return F.when(first, text).otherwise(F.concat(F.lit(","), text))


def lines(heads: DataFrame, sections: list[Section], key: str) -> DataFrame:
    """(key, section, item, sub, text): concatenated in order, one JSON document per row of ``heads`` (key, body).

    The fields of ``body`` come first, then one array per section; items are numbered from 0.
    """
    at = lambda df, section, item, sub, text: df.select(
        key, F.lit(section).alias("section"), item.cast("long").alias("item"), sub.cast("long").alias("sub"), text.alias("text"))
    whole = lambda n: F.lit(n)
    body = F.rtrim(F.col("body"))
    open_body = F.substr(body, F.lit(1), F.length(body) - 1)
    out = at(heads, 0, whole(-1), whole(0), open_body)
    for n, s in enumerate(sections, 1):
        comma = F.when((F.lit(n) > 1) | (F.trim(F.regexp_replace("body", r"[{}]", "")) != ""), ",").otherwise("")
        out = out.unionByName(at(heads, n, whole(-1), whole(0), F.concat(comma, F.lit(f'"{s.name}":['))))
        first = s.rows.groupBy(key).agg(F.min("item").alias("_first"))
        rows = s.rows.join(first, key)
        leads = F.col("item") == F.col("_first")
        if s.children is None:
            out = out.unionByName(at(rows, n, F.col("item"), whole(0), _comma(leads, F.col("body"))))
        else:
            inner = F.length("body") - 1
            opened = F.concat(F.substr(F.col("body"), F.lit(1), inner), F.when(F.length("body") > 2, ",").otherwise(""), F.lit(f'"{s.child}":['))
            out = out.unionByName(at(rows, n, F.col("item"), whole(-1), _comma(leads, opened)))
            lowest = s.children.groupBy(key, "item").agg(F.min("sub").alias("_first"))
            out = out.unionByName(at(s.children.join(lowest, [key, "item"]), n, F.col("item"), F.col("sub"), _comma(F.col("sub") == F.col("_first"), F.col("body"))))
            out = out.unionByName(at(rows, n, F.col("item"), whole(_LAST), F.lit("]}")))
        out = out.unionByName(at(heads, n, whole(_LAST), whole(0), F.lit("]")))
    return out.unionByName(at(heads, len(sections) + 1, whole(0), whole(0), F.lit("}")))


def any_order(*columns: str) -> Column:
    """A place for rows whose order does not matter, the same in every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(_LAST - 1))


def object_of(*columns: str | Column) -> Column:
    """A JSON object of the columns; nulls are left out."""
    return F.to_json(F.struct(*columns))


# -- documents ---------------------------------------------------------------------

def review_document(reviews: DataFrame, findings: DataFrame, lens_results: DataFrame, key: str = "run_id", ord: str = "ord") -> DataFrame:
    """Lines of review reports: header, findings in order, and what each lens did.

    ``reviews`` has one row per review with any columns; ``lens_results`` has the
    key, ``lens`` and any more.
    """
    rest = lambda df, *drop: object_of(*[c for c in df.columns if c not in (key, *drop)])
    heads = reviews.select(key, rest(reviews).alias("body"))
    rows = findings.select(key, F.col(ord).cast("long").alias("item"), rest(findings, ord).alias("body"))
    lenses = lens_results.select(key, any_order("lens").alias("item"), rest(lens_results).alias("body"))
    return lines(heads, [Section("findings", rows), Section("lenses", lenses)], key)


def scan_document(totals: DataFrame, chunks: DataFrame, raw: DataFrame, findings: DataFrame, coverage: DataFrame, key: str = "repo") -> DataFrame:
    """Lines of scan reports: totals, chunks with the findings each one gave, merged findings, coverage.

    ``chunks`` has (key, domain, chunk_id) rows, ``raw`` the findings with these
    columns and ``n``; ``findings`` are ordered by ``ord``.
    """
    rest = lambda df, *drop: object_of(*[c for c in df.columns if c not in (key, *drop)])
    heads = totals.select(key, rest(totals).alias("body"))
    item = any_order("domain", "chunk_id").alias("item")
    every = chunks.select(key, "domain", "chunk_id").distinct().select(key, item, object_of("domain", "chunk_id").alias("body"))
    told = raw.select(key, item, F.col("n").cast("long").alias("sub"), rest(raw, "domain", "chunk_id", "n").alias("body"))
    merged = findings.select(key, F.col("ord").cast("long").alias("item"), rest(findings, "ord").alias("body"))
    per_domain = coverage.select(key, any_order("domain").alias("item"), rest(coverage).alias("body"))
    return lines(heads, [Section("chunks", every, "findings", told), Section("findings", merged), Section("coverage", per_domain)], key)


def trace_document(stats: DataFrame, tools: DataFrame, signals: DataFrame, key: str = "session") -> DataFrame:
    """Lines of session reports: statistics, calls per tool, and process findings by ``ord``."""
    rest = lambda df, *drop: object_of(*[c for c in df.columns if c not in (key, *drop)])
    heads = stats.select(key, rest(stats).alias("body"))
    per_tool = tools.select(key, any_order(*[c for c in tools.columns if c != key]).alias("item"), rest(tools).alias("body"))
    found = signals.select(key, F.col("ord").cast("long").alias("item"), rest(signals, "ord").alias("body"))
    return lines(heads, [Section("tools", per_tool), Section("findings", found)], key)


def sarif_document(runs: DataFrame, findings: DataFrame, tool: str = "codewarden", version: str = "1.0.0", key: str = "run_id", ord: str = "ord", review: bool = True) -> DataFrame:
    """Lines of one SARIF log per row of ``runs``, clean ones included; the other columns of ``runs`` are the properties of its invocation."""
    place = lambda df, section, text: df.select(key, F.lit(section).alias("section"), F.col("ord").cast("long").alias("item"), F.lit(0).cast("long").alias("sub"), text.alias("text"))

    def listed(df: DataFrame, section: int, column: str) -> DataFrame:
        first = df.groupBy(key).agg(F.min("ord").alias("_first"))
        return place(df.join(first, key), section, _comma(F.col("ord") == F.col("_first"), F.col(column)))

    edge = runs.withColumn("ord", F.lit(0))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"{VERSION}","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":['
    tail = F.concat(F.lit('],"invocations":[{"executionSuccessful":true,"properties":'), object_of(*[c for c in runs.columns if c != key]) if len(runs.columns) > 1 else F.lit("{}"), F.lit("}]}]}"))
    return (place(edge, 0, F.lit(head)).unionByName(listed(rules(findings, key, ord, once=review), 1, "rule")).unionByName(place(edge, 2, F.lit(']}},"results":[')))
            .unionByName(listed(results(findings, key, ord, review), 3, "result")).unionByName(place(edge, 4, tail)))


# -- the sink ------------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    """Names of finished documents and the files that hold them."""

    files: list[tuple[str, str]]


class DocumentWriter(DataSourceArrowWriter):
    """Streams lines (name, text) into one file per name; rows of a name are together and in order."""

    def __init__(self, options, overwrite: bool):
        self.path, self.ending, self.overwrite = options["path"], options.get("ending", ".json"), overwrite
        self.staging = os.path.join(self.path, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.staging, exist_ok=True)
        done, name, out = [], None, None
        for batch in iterator:
            for key, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                if key != name:
                    if out:
                        out.close()
                    name, staged = key, os.path.join(self.staging, uuid.uuid4().hex)
                    out = open(staged, "w", encoding="utf-8")
                    done.append((key, staged))
                out.write(text)
                out.write("\n")
        if out:
            out.close()
        return Written(done)

    def commit(self, messages) -> None:
        if self.overwrite:
            for old in os.listdir(self.path) if os.path.isdir(self.path) else []:
                if old.endswith(self.ending):
                    os.remove(os.path.join(self.path, old))
        for m in messages:
            for name, staged in m.files if m else []:
                os.replace(staged, os.path.join(self.path, f"{name}{self.ending}"))
        self.abort(messages)

    def abort(self, messages) -> None:
        """Remove what is staged: all of it, or what attempts left that did not count."""
        for name in os.listdir(self.staging) if os.path.isdir(self.staging) else []:
            os.remove(os.path.join(self.staging, name))
        if os.path.isdir(self.staging):
            os.rmdir(self.staging)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reportdocuments"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, overwrite)


def write(document: DataFrame, path: str, key: str = "run_id", ending: str = ".json", overwrite: bool = True) -> None:
    """One file per document in a folder that all nodes have mounted.

    A document is one file, so one task writes it; it streams through, whatever
    its size.  A failed job leaves the folder as it was.
    """
    document.sparkSession.dataSource.register(DocumentSink)
    rows = document.withColumn("name", F.col(key).cast("string"))
    (rows.repartition("name").sortWithinPartitions("name", *PLACE).select("name", "text")
     .write.format(DocumentSink.name()).mode("overwrite" if overwrite else "append").option("ending", ending).save(path))


# -- reading back --------------------------------------------------------------------

def read_flat(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents without nested items, as `write` leaves them: items (name, section, n, body) and frames (name, frame).

    A frame holds the lines that are no items, in order: what comes before the
    first section, between two of them, and after the last one.  Items follow
    frame line ``section`` (from 1) and are numbered from 1.  Files are read in
    splits, and only frames are gathered.  A document whose items are not parted
    by commas is no JSON: it has no items, and its frame is null.
    """
    name = F.regexp_extract("session", r"([^/]*)\.[a-z]+$", 1)
    lines_ = read_lines(spark, path).select(name.alias("name"), "pos", "line")
    led = F.col("line").startswith("{") & (F.col("pos") > 1)
    item = led | F.col("line").startswith(",{")
    edge = F.when(~item, F.struct("pos", "line"))
    edges = lines_.filter(led | ~item).groupBy("name").agg(
        F.array_sort(F.collect_list(edge)).alias("_edges"), F.collect_list(F.when(led, F.col("pos"))).alias("_led"))
    at = F.transform("_edges", lambda e: e["pos"])
    sound = F.forall("_led", lambda p: F.array_contains(at, p - 1))
    edges = edges.select("name", F.when(sound, F.col("_edges")).alias("_edges"), F.when(sound, at).alias("_at"))
    before = F.filter("_at", lambda p: p < F.col("pos"))
    items = (lines_.filter(item).join(edges.filter("_at is not null").select("name", "_at"), "name").withColumn("_before", before)
             .select("name", F.size("_before").alias("section"), (F.col("pos") - F.array_max("_before")).alias("n"),
                     F.when(F.col("line").startswith(","), F.expr("substring(line, 2)")).otherwise(F.col("line")).alias("body")))
    return items, edges.select("name", F.transform("_edges", lambda e: e["line"]).alias("frame"))
