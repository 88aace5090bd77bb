"""The codebase scan as one job: discover, pack, ask, check rules, merge, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import classify, findings, inference, merge, packing, rules, scanners
from ..operators.ordered import row_positions
from ..session import cut_lineage
from ..sources import corpus, responses
from . import flow
from .flow import FlowAnalysis, FlowOptions


@dataclass(frozen=True)
class ScanOptions:
    """Everything a caller may set; the defaults are the stock scan."""

    budget_tokens: int = 100_000
    focus: tuple[str, ...] = ()
    order: str = "path"
    target: str = "."
    branch: str = "main"
    system: str = ""
    scanners: tuple[rules.Scanner, ...] = tuple(scanners.STOCK)
    rules: rules.RuleOptions = field(default_factory=rules.RuleOptions)
    hotspots: int = 10
    flow: FlowOptions | None = None


@dataclass
class Scan:
    """``chunks`` and ``prompts`` show what was asked; ``failed`` which chunks got no
    answer; ``merged`` holds the findings and ``suppressed`` those that the baseline
    knows; ``raw`` are the chunks' findings before any merge, ``flow`` is the data-flow
    analysis, the rest are reports per repository."""

    chunks: DataFrame
    prompts: DataFrame
    failed: DataFrame
    merged: DataFrame
    suppressed: DataFrame
    coverage: DataFrame
    hotspots: DataFrame
    totals: DataFrame
    raw: DataFrame | None = None
    flow: FlowAnalysis | None = None


_SHARED = ["repo", "place", "severity", "category", "location", "summary", "detail", "suggestion", "lenses", "deterministic", "score", "id"]


def scan(files: DataFrame, complete: Callable[[str, str], str] | None = None, options: ScanOptions = ScanOptions(),
         baseline: DataFrame | None = None, agreements: DataFrame | None = None) -> Scan:
    """Scan (repo, path, size, content) files; without ``complete`` only rules look at them.

    Findings come in the order chunks, rules, flows, which decides merges: chunks
    by their domain's first file and by number, rules by path and line.  Each
    finding carries its domain among its lenses.  ``baseline`` has (repo,
    fingerprint) of known findings, which are set apart after the merge.
    """
    found = corpus.limit_content(classify.discover(files, list(options.focus) or None))
    chunks = cut_lineage(packing.pack_chunks(found, options.budget_tokens, options.order))
    prompts = packing.chunk_prompts(chunks, found, options.budget_tokens, options.target, options.branch, order=options.order)
    hits = rules.scan_files(found.select("repo", "path", "content"), options.scanners or scanners.STOCK, options.rules)
    if not options.scanners:
        hits = hits.filter(F.lit(False))
    whole = lambda c: c.cast("int") if isinstance(c, Column) else F.lit(c)
    at = lambda stage, a, path, b, c: F.struct(F.lit(stage).alias("stage"), whole(a).alias("a"), path.alias("path"), whole(b).alias("b"), whole(c).alias("c"))
    with_domain = lambda domain: F.array_union(F.coalesce("lenses", F.array().cast("array<string>")), F.array(domain))
    rows = hits.withColumns({"place": at(1, 0, F.col("path"), F.col("line_no"), F.col("rule_no")), "score": F.col("confidence").cast("double"),
                             "lenses": with_domain(F.lit("general"))}).select(_SHARED)
    keys = ["repo", "domain", "chunk_id"]
    analysis = raw_findings = None
    if complete is None:
        answers = chunks.sparkSession.createDataFrame([], "repo string, domain string, chunk_id string, items int, message string")
        failed, told = answers.select(*keys, "message"), answers.select(*keys, F.lit(0).alias("n_findings"))
    else:
        raw = cut_lineage(inference.infer(prompts.withColumn("system", F.lit(options.system)), complete, keys))
        read = responses.ingest_findings(raw, keys)
        # Domains are few: one row each per repository.
        first = found.filter("content IS NOT NULL").groupBy("repo", "domain").agg(F.min(options.order).alias("_first"))
        turn = first.withColumn("_turn", F.row_number().over(Window.partitionBy("repo").orderBy("_first"))).drop("_first")
        numbers = chunks.select(*keys, "chunk_no").distinct().join(turn, ["repo", "domain"])
        raw_findings = responses.explode_findings(read, keys, "domain")
        answers = raw_findings.join(numbers, keys)
        rows = rows.unionByName(answers.withColumns({
            "place": at(0, F.col("_turn"), F.lit(""), F.col("chunk_no"), F.col("n")), "deterministic": F.lit(False),
            "score": F.lit(None).cast("double"), "lenses": with_domain(F.col("domain"))}).select(_SHARED))
        failed = read.join(raw.select(*keys, "error"), keys).select(*keys, F.coalesce("error", "message").alias("message")).filter("message is not null")
        told = read.select(*keys, F.coalesce(F.size("items"), F.lit(0)).alias("n_findings"))
        if options.flow is not None:
            analysis = flow.analyse(found, complete, options.flow, agreements)
            rows = rows.unionByName(analysis.findings.withColumns({
                "place": at(2, 0, F.lit(""), F.regexp_extract("id", "([0-9]+)$", 1), 0), "deterministic": F.lit(False), "lenses": with_domain(F.lit("data-flow"))}).select(_SHARED))
    ordered = cut_lineage(row_positions(rows, ["repo"], [F.col("place"), F.col("id")], "ord").drop("place"))
    merged = merge.scan_dedup(ordered, ["repo"])
    if baseline is not None:
        merged = findings.split_baseline(findings.with_fingerprint(merged), baseline, ["repo", "fingerprint"]).drop("fingerprint")
    else:
        merged = merged.withColumn("suppressed", F.lit(False))
    merged = cut_lineage(merged)
    new, suppressed = (merged.filter(c).drop("suppressed") for c in ("NOT suppressed", "suppressed"))
    results = told.withColumn("error", F.lit(None).cast("string"))
    counts = found.groupBy("repo").agg(
        F.count(F.lit(1)).alias("discovered"), F.count("content").alias("scanned"), F.count_if(F.col("content").isNull()).alias("skipped"))
    per_chunk = chunks.groupBy("repo").agg(F.countDistinct("domain", "chunk_no").alias("chunks"))
    known = suppressed.groupBy("repo").agg(F.count(F.lit(1)).alias("suppressed"))
    totals = counts.join(per_chunk, "repo", "left").join(findings.severity_counts(new, "repo", counts), "repo", "left").join(known, "repo", "left").fillna(0)
    return Scan(chunks, prompts, failed, new, suppressed, findings.coverage(chunks, results), findings.hotspots(new, "repo", options.hotspots), totals, raw_findings, analysis)
