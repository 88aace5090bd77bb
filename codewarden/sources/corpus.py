"""File corpora: directories of text files or tables with the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import MAX_FILE_BYTES, SKIP_DIRS, SKIP_ENDINGS, SKIP_NAMES
from ..functions.jsregex import quote


def wanted(path: Column) -> Column:
    """Neither in a skipped directory nor a skipped kind of file."""
    dirs = "|".join(quote(d) for d in SKIP_DIRS)
    name = F.lower(F.regexp_extract(path, r"([^/]*)\z", 1))
    ends = "|".join(quote(e) for e in SKIP_ENDINGS)
    return ~path.rlike(rf"(?:^|/)(?:{dirs})/") & ~name.isin(SKIP_NAMES) & ~name.rlike(rf"(?:{ends})\z")


def decoded(content: Column) -> Column:
    """Text of a file's bytes; bytes that are not UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def list_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path, size) without reading any content."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.regexp_replace(full, "^" + quote(root.rstrip("/")) + "/", "")
    return base.select(F.lit(repo).alias("repo"), rel.alias("path"), F.col("length").alias("size")).filter(wanted(F.col("path")))


def read_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path, size, content); content is null above 100 KB.

    Only files within the limit are opened: the length filter is pushed into
    the source, larger ones are listed by a second branch without content.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.regexp_replace(full, "^" + quote(root.rstrip("/")) + "/", "")
    small = base.filter(F.col("length") <= MAX_FILE_BYTES).select(
        F.lit(repo).alias("repo"), rel.alias("path"), F.col("length").alias("size"), decoded(F.col("content")).alias("content"))
    large = base.filter(F.col("length") > MAX_FILE_BYTES).select(
        F.lit(repo).alias("repo"), rel.alias("path"), F.col("length").alias("size"), F.lit(None).cast("string").alias("content"))
    return small.unionByName(large).filter(wanted(F.col("path")))


def limit_content(files: DataFrame) -> DataFrame:
    """Apply the size limit to a table that already holds content."""
    return files.withColumn("content", F.when(F.col("size") <= MAX_FILE_BYTES, F.col("content")))
