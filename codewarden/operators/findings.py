"""Findings algebra: validation, suppression, attachment, counts and order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text
from ..session import cut_lineage
from .ordered import first_k, ordered_union

# Score limits of the validation gate, fixable severities.
DISPROVEN_BELOW = 40
CONFIRMED_FROM = 60
FIXABLE = ["CRITICAL", "HIGH", "MEDIUM"]
# Batch sizes and the evidence limit in characters.
SCORE_BATCH = 10
VERIFY_BATCH = 5
EVIDENCE_CHARS = 7000
EVIDENCE_MARKER = "\n...[truncated for validation]"
VERDICT_MISSING = "Verification response missing for this fix"


# -- validation ------------------------------------------------------------------

def disposition(score: Column, deterministic: Column, min_confidence: int = 40) -> Column:
    return (F.when(F.coalesce(deterministic, F.lit(False)), "confirmed")
            .when(score.isNull(), "unvalidated")
            .when((score < min_confidence) | (score < DISPROVEN_BELOW), "disproven")
            .when(score < CONFIRMED_FROM, "uncertain")
            .otherwise("confirmed"))


def visible(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("disposition").eqNullSafe("disproven"))


def fixable(findings: DataFrame, min_confidence: int | None = None) -> DataFrame:
    d = visible(findings).filter(F.col("severity").isin(FIXABLE))
    if min_confidence:
        d = d.filter(F.col("score").isNull() | (F.col("score") >= min_confidence))
    return d


def severity_gate(findings: DataFrame, fail_on: str, key: str = "run_id", runs: DataFrame | None = None) -> DataFrame:
    """Whether a run fails; one of ``runs`` without findings passes."""
    limit = sev.SEVERITIES.index(fail_on)
    gate = findings.groupBy(key).agg(F.bool_or(sev.rank(F.col("severity")) <= limit).alias("failed"))
    return gate if runs is None else runs.select(key).distinct().join(gate, key, "left").fillna(False)


def attach_scores(findings: DataFrame, scores: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Left join of a score per id; a repeated id keeps its last score."""
    last = scores.groupBy(*keys).agg(F.max_by("score", seq).alias("score"))
    return findings.join(last, keys, "left")


def attach_verdicts(fixes: DataFrame, verdicts: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Verdict per fix; a missing one counts as failed, with a reason."""
    last = verdicts.groupBy(*keys).agg(F.max_by(F.struct("passed", "issues"), seq).alias("_v"))
    return (fixes.join(last, keys, "left")
            .withColumn("passed", F.coalesce("_v.passed", F.lit(False)))
            .withColumn("issues", F.coalesce("_v.issues", F.array(F.lit(VERDICT_MISSING))))
            .drop("_v"))


# -- baseline --------------------------------------------------------------------

def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", text.fingerprint(
        F.col("location"), F.col("category"), F.col("summary")))


def split_baseline(findings: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``suppressed``.  Known fingerprints are few next to findings, and a
    repeated fingerprint in the baseline must not repeat the finding."""
    known = baseline.select(*keys).distinct().withColumn("_known", F.lit(True))
    return (findings.join(known, keys, "left")
            .withColumn("suppressed", F.coalesce("_known", F.lit(False))).drop("_known"))


# -- merging exact copies ----------------------------------------------------------

def merge_exact(findings: DataFrame, keys: list[str], ord: str = "ord") -> DataFrame:
    """One row per (keys, file, severity, normalised summary).

    First row is the base, lenses are united in order of appearance, the
    longest detail wins and ties keep the earlier one.  Everything is a
    fixed-size aggregate with a map-side combine, so copies of one finding may
    be any share of the table.
    """
    d = findings.withColumns({"_file": text.file_key(F.col("location")),
                              "_summary": text.summary_key(F.col("summary"))})
    group = [*keys, "_file", "severity", "_summary"]
    rest = [c for c in findings.columns if c not in (*keys, "severity", "lenses", "detail")]
    base = d.groupBy(*group).agg(
        F.min_by(F.struct(*rest), ord).alias("_base"),
        F.max_by("detail", F.struct(F.length("detail"), -F.col(ord))).alias("detail"),
        F.count(F.lit(1)).alias("copies"))
    lenses = ordered_union(d, group, F.col("lenses"), F.col(ord), "lenses")
    return (base.join(lenses, group, "left")
            .select(*keys, "severity", "_base.*", "detail",
                    F.coalesce("lenses", F.array().cast("array<string>")).alias("lenses"), "copies"))


# -- locations ---------------------------------------------------------------------

def comment_body(label: str = "codewarden") -> Column:
    """Text of an inline comment."""
    lenses = F.when(F.size("lenses") > 1, F.array_join("lenses", " + ")).otherwise(
        F.coalesce(F.get(F.col("lenses"), 0), F.lit("unknown")))
    head = F.concat(F.lit("**"), sev.lookup(F.col("severity"), sev.SEVERITY_MARK), F.lit(" "), F.col("severity"),
                    F.lit(" — "), F.col("category"), F.lit("**\n> "), F.col("summary"), F.lit("\n\n"), F.col("detail"))
    advice = F.when(F.coalesce(F.col("suggestion"), F.lit("")) != "",
                    F.concat(F.lit("\n\n**Suggestion:** "), F.col("suggestion"))).otherwise("")
    return F.concat(head, advice, F.lit(f"\n\n*{label} ["), lenses, F.lit("]*"))


def map_inline(findings: DataFrame, changed: DataFrame, key: str = "run_id") -> DataFrame:
    """Add ``inline`` (lands on a changed file), ``path``, ``line``, ``body``."""
    files = changed.select(key, F.col("filename").alias("path")).distinct().withColumn("_hit", F.lit(True))
    d = findings.withColumns({"path": text.inline_path(F.col("location")), "line": text.inline_line(F.col("location"))})
    return (d.join(files, [key, "path"], "left")
            .withColumn("inline", F.coalesce("_hit", F.lit(False))).drop("_hit")
            .withColumn("body", F.when(F.col("inline"), comment_body())))


def attach_patch(findings: DataFrame, changed: DataFrame, key: str = "run_id", take: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Patch of the first changed file equal to, or ending with, the finding's file.

    ``take`` names what a finding gets of its ``patch``, the text itself by
    default; it is worked out once per changed file, and findings without one
    get it of the empty text.

    "Ends with" becomes an equi-join: the suffixes of a changed name that have the
    length of a file some finding of the run asks for.  Names travel alone; the
    patch is joined once the file is known.
    """
    d = findings.withColumn("_file", text.file_of(F.col("location")))
    asked = d.select(key, "_file").distinct()
    sizes = asked.groupBy(key).agg(F.collect_set(F.length("_file")).alias("_sizes"))
    suffixes = (changed.select(key, "filename", "file_ord").join(sizes, key)
                .select(key, "file_ord", F.length("filename").alias("_n"), "filename", F.explode("_sizes").alias("_size")).filter("_size <= _n")
                .select(key, "file_ord", F.expr("substring(filename, _n - _size + 1)").alias("_file")))
    best = suffixes.join(asked, [key, "_file"]).groupBy(key, "_file").agg(F.min("file_ord").alias("file_ord"))
    take = take or {"patch": lambda p: p}
    of = lambda p: F.struct(*[value(p).alias(name) for name, value in take.items()])
    patches = changed.select(key, "file_ord", of(F.coalesce("patch", F.lit(""))).alias("_p"))
    return (d.join(best.join(patches, [key, "file_ord"]).drop("file_ord"), [key, "_file"], "left")
            .withColumn("_p", F.coalesce("_p", of(F.lit("")))).withColumns({name: F.col(f"_p.{name}") for name in take}).drop("_p", "_file"))


def batch_number(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """Batch index of every row: numbering is by range slices, see ordered.py."""
    from .ordered import row_positions

    return row_positions(df, keys, order, "_n").withColumn(
        "batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def batch_evidence(batched: DataFrame, changed: DataFrame, diffs: DataFrame, key: str = "run_id", chars: int = EVIDENCE_CHARS,
                   take: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Evidence text per batch: patches of its files, else the whole diff.

    Files that repeat in the batch are met once.  Which files a batch shows and
    where its text ends follow from names and lengths, so no patch moves before
    that is known; batches that show the same files share one text.

    ``take`` names what a batch gets of its ``evidence``, the text itself by
    default; it is worked out once per set of files (or whole diff), so no batch
    carries more than it asks for.
    """
    take = take or {"evidence": lambda e: e}
    of = lambda e: F.struct(*[value(e).alias(name) for name, value in take.items()])
    # Cut here: rows are numbered and names cut out of locations a single time, and no task sorts and groups at once.
    named = cut_lineage(batched.select(key, "batch", text.file_of(F.col("location")).alias("filename")))
    files = named.filter("filename <> ''").distinct()
    # A longer text is cut, so one character more than the limit is all that has to move.
    shown = F.concat(F.lit("diff for "), "filename", F.lit("\n"), F.left("patch", F.lit(chars + 1)))
    place = F.struct("file_ord", F.row_number().over(Window.partitionBy(key, "file_ord").orderBy("t")).alias("n"))
    texts = cut_lineage(changed.filter("patch <> ''").select(key, "filename", "file_ord", shown.alias("t")).filter("t is not null")
                        .withColumn("_at", place))
    parts = (files.join(texts.select(key, "filename", "_at", F.length("t").alias("_n")), [key, "filename"])
             .groupBy(key, "batch").agg(F.array_sort(F.collect_list(F.struct("_at", "_n"))).alias("_l"))
             .select(key, "batch", _within("_l", chars).alias("_shown")))
    parts = cut_lineage(parts)
    cut = lambda c: F.when(F.length(c) > chars, F.concat(F.left(c, F.lit(chars)), F.lit(EVIDENCE_MARKER))).otherwise(F.col(c))
    joined = (parts.select(key, "_shown").distinct().select(key, "_shown", F.posexplode("_shown").alias("_i", "_at"))
              .join(texts.select(key, "_at", "t"), [key, "_at"]).groupBy(key, "_shown")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "t"))), lambda x: x["t"]), "\n\n").alias("_parts"))
              .select(key, "_shown", cut("_parts").alias("_e")).select(key, "_shown", of(F.col("_e")).alias("_e")))
    every = named.select(key, "batch").distinct()
    whole = (every.join(parts.select(key, "batch"), [key, "batch"], "left_anti")
             .join(diffs.select(key, F.left("diff", F.lit(chars + 1)).alias("diff")).select(key, cut("diff").alias("_e")).select(key, of(F.col("_e")).alias("_e")), key, "left")
             .select(key, "batch", F.coalesce("_e", of(F.lit(None).cast("string"))).alias("_e")))
    return parts.join(joined, [key, "_shown"]).select(key, "batch", "_e").unionByName(whole).select(key, "batch", *[F.col(f"_e.{name}") for name in take])


def _within(parts: str, chars: int) -> Column:
    """Places of the parts that a text of ``chars`` characters and one more can show: those before which it is not over."""
    begun = F.aggregate(parts, F.struct(F.lit(-2).cast("long").alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(
        (a["end"] + 2 + x["_n"]).alias("end"), (a["n"] + (a["end"] <= chars).cast("int")).alias("n")))
    return F.transform(F.slice(parts, F.lit(1), begun["n"]), lambda x: x["_at"])


# -- counts ------------------------------------------------------------------------

def severity_counts(findings: DataFrame, key: str = "run_id", runs: DataFrame | None = None) -> DataFrame:
    """All five levels, also when a level has no finding; ``runs`` adds clean runs."""
    counts = findings.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(F.col("severity") == s).alias(s) for s in sev.SEVERITIES])
    return counts if runs is None else every_run(runs, counts, key)


def every_run(runs: DataFrame, counts: DataFrame, key: str = "run_id") -> DataFrame:
    """Counts for all runs; a run without findings has zeros."""
    return runs.select(key).distinct().join(counts, key, "left").fillna(0)


def lens_counts(findings: DataFrame, key: str = "run_id") -> DataFrame:
    return (findings.select(key, F.explode(F.array_distinct("lenses")).alias("lens"))
            .groupBy(key, "lens").agg(F.count(F.lit(1)).alias("findings")))


def lens_status(results: DataFrame, findings: DataFrame, key: str = "run_id") -> DataFrame:
    """Status per lens that ran: errored, parse_error, clean or findings."""
    counts = lens_counts(findings, key)
    return (results.select(key, "lens", "error", "parse_error").join(counts, [key, "lens"], "left")
            .select(key, "lens", F.when(F.coalesce("error", F.lit("")) != "", "errored")
                    .when(F.col("parse_error"), "parse_error")
                    .when(F.coalesce("findings", F.lit(0)) == 0, "clean").otherwise("findings").alias("status")))


def review_confidence(results: DataFrame, key: str = "run_id") -> DataFrame:
    bad = F.bool_or((F.coalesce("error", F.lit("")) != "") | F.col("parse_error"))
    return results.groupBy(key).agg(F.when(bad, "LOW").otherwise("NORMAL").alias("confidence"))


def validation_counts(findings: DataFrame, key: str = "run_id") -> DataFrame:
    d = F.col("disposition")
    named = ["confirmed", "uncertain", "disproven"]
    return findings.groupBy(key).agg(
        *[F.count_if(d == n).alias(n) for n in named],
        F.count_if(~F.coalesce(d.isin(named), F.lit(False))).alias("unvalidated"),
        F.count_if(d == "disproven").alias("filtered"))


def domain_counts(chunk_results: DataFrame, key: str = "repo") -> DataFrame:
    """Raw findings, errored chunks and cleanliness per domain."""
    n = F.coalesce(F.sum("n_findings"), F.lit(0))
    return chunk_results.groupBy(key, "domain").agg(
        n.alias("findings"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errored_chunks"),
        (n == 0).alias("clean"))


def coverage(chunk_files: DataFrame, chunk_results: DataFrame, key: str = "repo") -> DataFrame:
    files = chunk_files.select(key, "domain", "path").distinct().groupBy(key, "domain").agg(
        F.count(F.lit(1)).alias("files_scanned"))
    return (files.join(domain_counts(chunk_results, key).select(key, "domain", "findings"), [key, "domain"], "left")
            .fillna(0, ["findings"]))


def hotspots(findings: DataFrame, key: str = "run_id", k: int = 10) -> DataFrame:
    """Heaviest locations (line included) of each run, with a breakdown."""
    per = findings.groupBy(key, "location").agg(
        F.sum(sev.hotspot_weight(F.col("severity"))).alias("score"), F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in sev.SEVERITIES], F.min("ord").alias("_first"))
    return first_k(per, [key], [F.desc("score"), F.desc("total"), F.col("_first")], k).drop("_first")


def fix_counts(fixes: DataFrame, key: str = "run_id") -> DataFrame:
    s = F.col("status")
    return fixes.groupBy(key).agg(F.count(F.lit(1)).alias("eligible"), F.count_if(s != "failed").alias("generated"),
                                  *[F.count_if(s == x).alias(x) for x in ("verified", "reverted", "failed")])


def vote_counts(merged: DataFrame, raw: DataFrame, models: int, key: str = "run_id", runs: DataFrame | None = None) -> DataFrame:
    a = F.col("agreement")
    counts = merged.groupBy(key).agg(
        F.count(F.lit(1)).alias("merged"), F.count_if(a == models).alias("unanimous"),
        F.count_if((a > 1) & (a < models)).alias("majority"), F.count_if(a == 1).alias("single")).join(
        raw.groupBy(key).agg(F.count(F.lit(1)).alias("raw")), key)
    return counts if runs is None else every_run(runs, counts, key)


def ensemble_stats(results: DataFrame, merged: DataFrame, raw: DataFrame, key: str = "run_id") -> DataFrame:
    """Models that ran and succeeded, raw and merged findings, and how many models agreed.

    ``results`` has one row per run and model with its ``error``; the number of
    models of a run is that of its rows, also where none of them found anything.
    """
    models = results.groupBy(key).agg(F.count(F.lit(1)).alias("models_run"), F.count_if(F.coalesce("error", F.lit("")) == "").alias("models_succeeded"))
    a, n = F.col("agreement"), F.col("models_run")
    agreed = merged.join(models.select(key, "models_run"), key).groupBy(key).agg(
        F.count(F.lit(1)).alias("merged"), F.count_if(a == n).alias("unanimous"), F.count_if((a > 1) & (a < n)).alias("majority"), F.count_if(a == 1).alias("single"))
    found = raw.groupBy(key).agg(F.count(F.lit(1)).alias("raw"))
    return models.join(found, key, "left").join(agreed, key, "left").fillna(0)


# -- order -------------------------------------------------------------------------

def report_order(lens_col: str = "lenses") -> list[Column]:
    """Severity, then best lens, then location in locale order."""
    best = F.array_min(F.transform(lens_col, sev.lens_rank))
    return [sev.rank(F.col("severity")), best, F.collate(F.col("location"), "UNICODE")]


def scan_order() -> list[Column]:
    return [sev.rank(F.col("severity")), F.col("ord")]


def vote_order() -> list[Column]:
    return [F.desc("agreement"), sev.rank(F.col("severity")), F.col("ord")]


def union_tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of findings from several origins; the origin joins the lenses."""
    out = None
    for origin, df in parts.items():
        tagged = df.withColumn("lenses", F.array_union("lenses", F.array(F.lit(origin))))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
