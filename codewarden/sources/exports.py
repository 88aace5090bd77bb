"""SARIF and JSON exports.

A report of any size is written as ordered text lines whose concatenation is
the document, so no run is ever assembled in one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text

# SARIF version and schema.
VERSION = "2.1.0"
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"


def _line(*pairs: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]))


def rules(findings: DataFrame, key: str = "run_id", ord: str = "ord", once: bool = True) -> DataFrame:
    """(run, ord, rule): one rule per id from its first finding, or per finding."""
    one = F.col("suggestion")
    body = _line(
        ("id", F.col("id")), ("shortDescription", F.struct(F.col("summary").alias("text"))),
        ("fullDescription", F.struct(F.col("detail").alias("text"))), ("help", F.struct(one.alias("text"), one.alias("markdown"))),
        ("defaultConfiguration", F.struct(sev.sarif_level(F.col("severity")).alias("level"))),
        ("properties", F.struct(F.col("lenses").alias("tags"), "category", "severity")))
    d = findings
    if once:
        cols = ["id", "summary", "detail", "suggestion", "severity", "lenses", "category", ord]
        d = findings.groupBy(key, F.col("id").alias("_id")).agg(F.min_by(F.struct(*cols), ord).alias("f")).select(key, "f.*")
    return d.select(key, F.col(ord).alias("ord"), body.alias("rule"))


def results(findings: DataFrame, key: str = "run_id", ord: str = "ord", review: bool = True) -> DataFrame:
    """(run, ord, result); a review also carries score and lenses."""
    message = F.concat("summary", F.lit("\n\n"), "detail", F.lit("\n\nSuggestion: "), "suggestion")
    place = F.struct(F.struct(F.struct(text.sarif_file(F.col("location")).alias("uri")).alias("artifactLocation"),
                              F.struct(text.sarif_line(F.col("location")).alias("startLine")).alias("region")).alias("physicalLocation"))
    props = ["category", "severity"] + ([F.col("score").alias("confidence"), "lenses"] if review else [])
    body = _line(("ruleId", F.col("id")), ("level", sev.sarif_level(F.col("severity"))),
                 ("message", F.struct(message.alias("text"))), ("locations", F.array(place)), ("properties", F.struct(*props)))
    return findings.select(key, F.col(ord).alias("ord"), body.alias("result"))


def sarif_lines(findings: DataFrame, tool: str = "codewarden", version: str = "1.0.0", key: str = "run_id", ord: str = "ord",
                review: bool = True, properties: str = "{}") -> DataFrame:
    """(run, part, ord, text): concatenated in order, one SARIF log per run."""
    r = rules(findings, key, ord, once=review).select(key, F.lit(1).alias("part"), "ord", F.col("rule").alias("text"))
    s = results(findings, key, ord, review).select(key, F.lit(3).alias("part"), "ord", F.col("result").alias("text"))
    body = r.unionByName(s)
    first = body.groupBy(key, "part").agg(F.min("ord").alias("_first"))
    body = body.join(first, [key, "part"]).withColumn("text", F.when(
        F.col("ord") == F.col("_first"), F.col("text")).otherwise(F.concat(F.lit(","), "text"))).drop("_first")
    head = (f'{{"$schema":"{SCHEMA}","version":"{VERSION}","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":[')
    tail = f'],"invocations":[{{"executionSuccessful":true,"properties":{properties}}}]}}]}}'
    frame = F.array(F.struct(F.lit(0).alias("part"), F.lit(head).alias("text")), F.struct(F.lit(2).alias("part"), F.lit(']}},"results":[').alias("text")),
                    F.struct(F.lit(4).alias("part"), F.lit(tail).alias("text")))
    edge = findings.select(key).distinct().select(key, F.explode(frame).alias("x")).select(
        key, "x.part", F.lit(0).cast("long").alias("ord"), "x.text")
    return body.select(key, "part", F.col("ord").cast("long").alias("ord"), "text").unionByName(edge)


def write_documents(lines: DataFrame, path: str, key: str = "run_id") -> None:
    """Text files per run; file and line order is document order."""
    (lines.repartitionByRange(key, "part", "ord").sortWithinPartitions(key, "part", "ord")
     .select(key, "text").write.mode("overwrite").partitionBy(key).text(path))


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """(run, row): each row of a report table as one JSON object."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*rest)).alias("row"))
