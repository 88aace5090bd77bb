"""The review of changes as one job: pack, ask, merge, score, gate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings, inference, merge, packing, prompts
from ..operators.ordered import row_positions
from ..session import cut_lineage
from ..sources import responses

SCORE_SYSTEM = (
    "Rate how sure it is that each finding is real, from 0 to 100, by the evidence given. "
    'Answer with one JSON object {"scores": [{"id": ..., "confidenceScore": ...}]}.')


@dataclass(frozen=True)
class ReviewOptions:
    """Everything a caller may set; the defaults are the stock review."""

    context_tokens: int = 128_000
    ignore: tuple[str, ...] = ()
    min_confidence: int = findings.DISPROVEN_BELOW
    fail_on: str = "HIGH"
    batch: int = findings.SCORE_BATCH
    score_system: str = SCORE_SYSTEM
    validate: bool = True


@dataclass
class Review:
    """``packed`` shows what of each diff was sent, ``prompts`` what was asked, ``failed`` which lenses
    gave no answer; ``merged`` holds all findings with score and disposition, ``shown`` those not disproven."""

    packed: DataFrame
    prompts: DataFrame
    failed: DataFrame
    merged: DataFrame
    shown: DataFrame
    status: DataFrame
    confidence: DataFrame
    counts: DataFrame
    gate: DataFrame


def score_prompts(merged: DataFrame, changed: DataFrame, diffs: DataFrame, options: ReviewOptions, key: str = "run_id") -> DataFrame:
    """One prompt per batch of findings, in their order, with the diffs of their files as evidence."""
    batched = cut_lineage(findings.batch_number(merged.select(key, "ord", "id", "severity", "location", "summary", "detail"), [key], [F.col("ord")], options.batch))
    listed = F.to_json(F.struct("id", "severity", "location", "summary", "detail"))
    texts = batched.groupBy(key, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", listed.alias("t")))), lambda x: x["t"]), "\n").alias("_list"))
    evidence = findings.batch_evidence(batched, changed, diffs, key)
    user = F.concat(F.lit("## Findings\n"), "_list", F.lit("\n\n## Evidence\n"), F.coalesce("evidence", F.lit("")))
    return texts.join(evidence, [key, "batch"], "left").select(key, "batch", F.lit(options.score_system).alias("system"), user.alias("user"))


def review(reviews: DataFrame, changed: DataFrame, diffs: DataFrame, lenses: DataFrame, complete: Callable[[str, str], str],
           options: ReviewOptions = ReviewOptions(), hipaa: DataFrame | None = None, codebase: DataFrame | None = None, key: str = "run_id") -> Review:
    """Review changes with every lens that `lenses.resolve` gave them.

    ``reviews`` has one row per change with the columns of `prompts.review_prompts`
    but the list of files, the note and the diff; ``changed`` has (key, filename,
    status, additions, deletions, changes, patch, file_ord), ``diffs`` (key, diff).
    Findings keep the order of lenses and answers, which decides merges.
    """
    kept = packing.drop_ignored(changed, list(options.ignore))
    sections = cut_lineage(packing.keep_sections(packing.diff_sections(diffs, key), kept, key))
    packed = cut_lineage(packing.pack_diff(packing.attach_sections(kept, sections, key), options.context_tokens, key, size=packing.diff_size(sections, key)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("file_ord", packing.file_line().alias("l")))), lambda x: x["l"])
    files = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"), F.array_join(lines, "\n").alias("file_list"))
    whole = packing.packed_review(packed, sections, key).select(key, "diff", "note")
    asked = cut_lineage(prompts.review_prompts(reviews.join(files, key).join(whole, key), lenses, hipaa, codebase, key=key))
    keys = [key, "lens"]
    raw = cut_lineage(inference.infer(asked, complete, keys))
    read = cut_lineage(responses.ingest_findings(raw, keys))
    results = read.join(raw.select(*keys, F.col("error").alias("_failed")), keys).select(
        *keys, F.col("_failed").alias("error"), (F.col("message").isNotNull() & F.col("_failed").isNull()).alias("parse_error"), "message")
    rows = responses.explode_findings(read, keys, "lens").join(lenses.select(*keys, F.col("ord").alias("_lens")), keys)
    ordered = cut_lineage(row_positions(rows, [key], [F.col("_lens"), F.col("n"), F.col("id")], "ord").drop("_lens", "n", "lens"))
    merged = cut_lineage(merge.review_dedup(ordered, [key]))
    if options.validate:
        scored = cut_lineage(inference.infer(score_prompts(merged, kept, diffs, options, key), complete, [key, "batch"]))
        scores = responses.ingest_scores(scored, [key, "batch"]).withColumn("seq", F.struct("batch", "n"))
        merged = findings.attach_scores(merged, scores, [key, "id"])
    else:
        merged = merged.withColumn("score", F.lit(None).cast("int"))
    merged = cut_lineage(merged.withColumn("disposition", findings.disposition(F.col("score"), F.lit(False), options.min_confidence)))
    shown = findings.visible(merged)
    runs = reviews.select(key)
    counts = findings.severity_counts(shown, key, runs).join(findings.validation_counts(merged, key), key, "left").fillna(0)
    return Review(packed, asked, results.filter("error IS NOT NULL OR parse_error").select(*keys, F.coalesce("error", "message").alias("message")), merged, shown,
                  findings.lens_status(results, merged, key), findings.review_confidence(results, key), counts, findings.severity_gate(shown, options.fail_on, key, runs))
