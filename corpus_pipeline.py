"""From raw documents to token digests: identify, deduplicate, mix, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; between stages the rows are written as Parquet and read again.
A reader deals files out by size, so the order of the rows is taken from the
numbers of the part files and of the rows inside them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codewarden.llm import byte_bpe, exact_dedup, lang_id, mixing, ngram_join
from codewarden.llm.common import table
from codewarden.session import scratch_dir

#: Documents whose best language has a lower probability are rejected, like those without a letter.
LEAST_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the classifier recognises."""
    scored = lang_id.predict(docs, lang_id.fit(docs), lang_out="_cw_lang", score_out="_cw_score")
    return scored.filter((F.col("_cw_lang") != lang_id.UNKNOWN) & (F.col("_cw_score") >= LEAST_SCORE)).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of equal texts: the longest original, then the smallest id."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every class of near copies."""
    return ngram_join.representatives(docs)


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted so that sources interleave by their target weights."""
    return mixing.interleaved(docs)


WRITTEN = ("_cw_part", "_cw_file", "_cw_row")


def as_written(docs: DataFrame) -> DataFrame:
    """Add the number and name of each row's part file and its number there; without files, those of its partition."""
    if docs.inputFiles():
        name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        part = F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) AS long)")
    else:
        name, part = F.lit(""), F.spark_partition_id().cast("long")
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return docs.select(*docs.columns, *(c.alias(k) for c, k in zip((part, name, row), WRITTEN)))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the tokens of every document, and of what they decode to, with its ``position`` in the mixed order."""
    own = as_written(docs)
    found = byte_bpe.round_trip(own, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, kept=WRITTEN)
    # One row per file: the number of rows in the files before it.
    before = Window.orderBy(*WRITTEN[:2]).rowsBetween(Window.unboundedPreceding, -1)
    base = (own.groupBy(*WRITTEN[:2]).agg((F.max("_cw_row") + 1).alias("n"))
            .select(F.struct(*WRITTEN[:2]).alias("_cw_at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_cw_base")))
    return (found.withColumn("_cw_at", F.struct(*WRITTEN[:2])).join(F.broadcast(base), "_cw_at")
            .withColumn("position", F.col("_cw_base") + F.col("_cw_row")).drop("_cw_at", "_cw_base", *WRITTEN))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", in_mixed_order),
    ("byte-level BPE encoding and decoding", token_digests),
]

#: SQL expresses neither the trained network nor the hashed order of a source.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = scratch_dir(spark, f"stage{n}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
