"""Caller's scanners as table functions for SQL.

A scanner is a small Python function from a path and a text to rows.  Registered,
it can be called from SQL with a lateral join; Spark spreads the files.  The
columns it returns beyond the common ones are named in the call and fixed when the
query is analysed:

    SELECT f.repo, s.* FROM files f, LATERAL todo(f.path, f.content, more => 'owner') s

A row is a dict; fields that it lacks are null and others are dropped.  A file
without content and one for which the scanner raises give no rows, or one row
with ``error`` set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Columns of every scanner.
COMMON = ("severity", "category", "summary", "detail", "suggestion")


def register(spark: SparkSession, name: str, scan: Callable[[str, str], Iterable[dict]]) -> None:
    """Make ``scan`` the table function ``name`` of the session."""

    class Scanner:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument, more: AnalyzeArgument | None = None) -> AnalyzeResult:
            if more is not None and not more.isConstantExpression:
                raise ValueError("more must be a constant list of columns")
            names = [c.strip() for c in (more.value if more is not None else "").split(",") if c.strip()]
            taken = [c for c in names if c in (*COMMON, "line", "error")]
            if taken:
                raise ValueError(f"columns that every scanner has: {', '.join(taken)}")
            fields = [StructField("line", IntegerType()), *[StructField(c, StringType()) for c in (*COMMON, *names, "error")]]
            return AnalyzeResult(StructType(fields))

        def eval(self, path: str, content: str, more: str | None = None):
            names = [*COMMON, *[c.strip() for c in (more or "").split(",") if c.strip()]]
            if content is None:
                return
            try:
                for row in scan(path, content):
                    yield (row.get("line"), *[None if row.get(c) is None else str(row[c]) for c in names], None)
            except Exception as err:  # the row says so, the job goes on
                yield (None, *[None] * len(names), str(err))

    spark.udtf.register(name, udtf(Scanner))


def scan_with(files: DataFrame, names: list[str], lenses: list[str] = ("custom",)) -> DataFrame:
    """Findings of registered scanners in the columns of `rules.scan_files`, for a union with it."""
    spark, out = files.sparkSession, None
    for name in names:
        found = spark.sql(f"SELECT f.repo, f.path, s.* FROM {{files}} f, LATERAL {name}(f.path, f.content) s", files=files).filter("error IS NULL")
        slug = F.regexp_replace(F.col("path"), r"[^A-Za-z0-9]+", "-")
        found = found.select(
            "repo", "path", F.col("line").alias("line_no"), F.concat(F.lit(f"{name}-"), slug, F.lit("-"), F.coalesce(F.col("line").cast("string"), F.lit("0"))).alias("id"),
            F.lit(name).alias("scanner_id"), "severity", "category", F.concat("path", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit(""))).alias("location"),
            "summary", "detail", "suggestion", F.array(*[F.lit(x) for x in lenses]).alias("lenses"))
        out = found if out is None else out.unionByName(found)
    return out
