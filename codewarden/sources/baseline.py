"""Baselines of known findings, one partition per target."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import with_fingerprint

COLUMNS = ["target", "fingerprint", "severity", "location", "summary", "suppressed_at"]
SCHEMA = "target string, fingerprint string, severity string, location string, summary string, suppressed_at timestamp"


def snapshot(findings: DataFrame, at: str | None = None) -> DataFrame:
    """Baseline rows of all findings; needs a ``target`` column."""
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return with_fingerprint(findings).withColumn("suppressed_at", when).select(*COLUMNS)


def write(rows: DataFrame, path: str, targets: DataFrame | None = None) -> None:
    """Replace the targets present in ``rows`` or listed in ``targets``; others stay.

    A listed target without rows gets one empty entry, which replaces its old
    ones; readers leave it out.
    """
    if targets is not None:
        gone = targets.select("target").distinct().join(rows.select("target"), "target", "left_anti")
        rows = rows.unionByName(gone, allowMissingColumns=True)
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Baseline table; a missing one suppresses nothing."""
    try:
        return spark.read.schema(SCHEMA).parquet(path).filter("fingerprint is not null")
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], SCHEMA)


def to_json(rows: DataFrame) -> DataFrame:
    """(target, entry): one JSON object per entry, for exchange."""
    return rows.select("target", F.to_json(F.struct(
        "fingerprint", "severity", "location", "summary", F.col("suppressed_at").alias("suppressedAt"))).alias("entry"))


def from_json(rows: DataFrame) -> DataFrame:
    entry = F.from_json("entry", "fingerprint string, severity string, location string, summary string, suppressedAt timestamp")
    return rows.select("target", entry.alias("e")).select("target", "e.fingerprint", "e.severity", "e.location", "e.summary",
                                                          F.col("e.suppressedAt").alias("suppressed_at"))
