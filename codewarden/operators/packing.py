"""Packing under a token budget, review diffs, prompts and snippets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.jsregex import path_glob
from ..functions.severity import lookup as sev_lookup
from ..session import cut_lineage
from .classify import security_relevant
from .ordered import first_k, row_positions

# Share of the budget that is packed, tokens kept for the rest of
# a review prompt, and display limits of the repository context.
FILL = 0.85
RESERVED_TOKENS = 4000
MAX_IMPORTS = 200
MAX_TREE = 500
SHOWN_TREE = 100


# -- next-fit chunks -------------------------------------------------------------

def pack_chunks(files: DataFrame, budget_tokens: int, order: str = "path") -> DataFrame:
    """Next-fit packing per (repo, domain) in priority order; adds ``chunk_no``,
    ``chunk_id`` and ``packed_tokens``.

    The packing is sequential, but a slice of the sequence can be summarised:
    for every fill level on entry, how many bins does it open and how full is
    the last one?  Slices come from a range partitioning, are summarised in
    parallel, the short list of summaries is folded per group, and each slice is
    then packed in parallel from its known entry level.  Only sizes travel.
    """
    limit = int(np.floor(budget_tokens * FILL))
    sized = (files.filter("content is not null")
             .withColumn("_t", text.tokens(F.col("content")))
             .select("repo", "domain", "priority", F.col(order).alias("_ord"), "path",
                     F.when(F.col("_t") > limit, text.tokens(text.head_and_tail(F.col("content"), F.lit(limit))))
                     .otherwise(F.col("_t")).cast("long").alias("packed_tokens")))
    placed = cut_lineage(
        sized.repartitionByRange("repo", "domain", "priority", "_ord")
        .sortWithinPartitions("repo", "domain", "priority", "_ord")
        .withColumn("_slice", F.spark_partition_id()))
    keys = ["repo", "domain", "_slice"]

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.sort_values(["priority", "_ord"])["packed_tokens"].to_numpy()
        reach, bins, left = slice_summary(t, limit)
        return pd.DataFrame([(*key, int(t.sum()), reach, bins, left)],
                            columns=[*keys, "total", "reach", "bins", "left"])

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    spans = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    several = spans.groupBy("repo", "domain").agg(F.count(F.lit(1)).alias("_s")).filter("_s > 1").select("repo", "domain")
    # Groups inside one slice need no summary: they start empty.
    table = (placed.join(several, ["repo", "domain"], "left_semi").groupBy(*keys)
             .applyInPandas(summarise, f"{schema}, total long, reach array<long>, bins array<long>, left array<long>"))

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        used, number, out = -1, 0, []
        for row in pdf.sort_values("_slice").itertuples(index=False):
            out.append((*key, row[2], used, number))
            used, number = slice_step(used, number, row[3], row[4], row[5], row[6], limit)
        return pd.DataFrame(out, columns=[*keys, "entry", "number"])

    entries = table.groupBy("repo", "domain").applyInPandas(chain, f"{schema}, entry long, number long")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "_ord"])
        t = pdf["packed_tokens"].to_numpy()
        pdf["chunk_no"] = pack_slice(t, limit, int(pdf["entry"].iloc[0]), int(pdf["number"].iloc[0]))
        return pdf[["repo", "domain", "path", "priority", "packed_tokens", "chunk_no"]]

    ready = placed.join(entries, keys, "left").fillna({"entry": -1, "number": 0})
    packed = ready.groupBy(*keys).applyInPandas(
        pack, f"repo {kinds['repo']}, domain string, path string, priority int, packed_tokens long, chunk_no long")
    return packed.withColumn("chunk_id", F.format_string("%s-%03d", "domain", "chunk_no"))


def _next_bins(t: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and, per start, the first item of the next bin."""
    total = np.concatenate([[0], np.cumsum(t)])
    nxt = np.searchsorted(total[1:], total[:-1] + limit, side="right")
    return total, np.maximum(nxt, np.arange(len(t)) + 1)


def slice_summary(t: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """(reach, bins, left) by first break position k: an entry level u breaks at
    the first k with u + reach[k] > limit, opens bins[k] bins, ends at left[k].

    Files without tokens reach no further than the one before them, so a run of
    them has no entry of its own.  Bins are followed by jumps of doubling length.
    """
    total, nxt = _next_bins(t, limit)
    n = len(t)
    jump, bins, last = np.append(nxt, n), np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    while (jump < n).any():
        last = np.where(jump < n, last[jump], last)
        bins = bins + bins[jump]
        jump = jump[jump]
    stop = min(int(np.searchsorted(total[1:], limit, side="right")) + 1, n)
    reach, ks = np.unique(total[1 : stop + 1], return_index=True)
    return reach.tolist(), bins[ks].tolist(), (total[n] - total[last[ks]]).tolist()


def slice_step(used: int, number: int, total: int, reach, bins, left, limit: int) -> tuple[int, int]:
    """Level and bin number after a slice; ``used`` = -1 means nothing is open."""
    if used < 0:
        return int(left[0]), number + int(bins[0])
    k = int(np.searchsorted(np.asarray(reach), limit - used, side="right"))
    if k >= len(reach):
        return used + int(total), number
    return int(left[k]), number + int(bins[k])


def pack_slice(t: np.ndarray, limit: int, used: int, number: int) -> np.ndarray:
    """Bin of every file of a slice that is entered with ``used`` tokens in bin ``number``; one step per bin."""
    total, nxt = _next_bins(t, limit)
    out = np.empty(len(t), dtype=np.int64)
    at = 0 if used < 0 else int(np.searchsorted(total[1:], limit - used, side="right"))
    out[:at] = number
    while at < len(t):
        number += 1
        out[at : nxt[at]] = number
        at = int(nxt[at])
    return out


# -- review diffs ------------------------------------------------------------------

def drop_ignored(changed: DataFrame, ignore: list[str]) -> DataFrame:
    d = changed
    for g in ignore:
        d = d.filter(~F.col("filename").rlike(path_glob(g)))
    return d


def diff_sections(diffs: DataFrame, key: str = "run_id") -> DataFrame:
    """(run, section_no, filename, section): preamble has a null filename."""
    parts = diffs.select(key, F.posexplode_outer(F.split("diff", "(?m)(?=^diff --git )")).alias("section_no", "section"))
    name = F.nullif(F.regexp_extract("section", r"^diff --git a/[^\n]+ b/([^\n]+)", 1), F.lit(""))
    return parts.filter("section <> ''").withColumn("filename", F.rtrim(name))


def keep_sections(sections: DataFrame, changed: DataFrame, key: str = "run_id") -> DataFrame:
    """Sections of files that are still in the review, and the preamble."""
    named = sections.filter("filename is not null").join(changed.select(key, "filename").distinct(), [key, "filename"], "left_semi")
    return named.unionByName(sections.filter("filename is null"))


def attach_sections(changed: DataFrame, sections: DataFrame, key: str = "run_id") -> DataFrame:
    """Add ``section`` (first one of the file) and ``skipped``."""
    first = sections.filter("filename is not null").groupBy(key, "filename").agg(F.min_by("section", "section_no").alias("_s"))
    d = changed.join(first, [key, "filename"], "left").withColumn("section", F.regexp_replace("_s", r"\n\z", "")).drop("_s")
    return d.withColumn("skipped", F.col("section").isNull() & (F.coalesce("patch", F.lit("")) == ""))


def file_line() -> Column:
    return F.format_string("- %s (%s, +%d/-%d)", "filename", "status", "additions", "deletions")


def diff_size(sections: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, diff_chars) of a diff from its sections, with its preamble and the files that nobody lists."""
    return sections.groupBy(key).agg(F.sum(F.length("section")).alias("diff_chars"))


def pack_diff(files: DataFrame, context_tokens: int, key: str = "run_id", salts: int = 32, size: DataFrame | None = None) -> DataFrame:
    """Skip-fit of diff sections; adds ``fate``: whole, packed, summary or skipped.

    ``size`` is `diff_size` of the whole remaining diff; without it the listed
    sections are measured.

    Security-relevant files first, then few changes first; a section that does
    not fit is summarised and later ones may still fit.  Room only shrinks, so
    once a section of some size is refused all later ones of that size are too:
    of one size at most ``budget // size`` sections can enter, and they are the
    first ones.  That bounds what a review sends to its fold, whatever its size.
    """
    d = files.withColumns({
        "tokens": text.tokens(F.col("section")), "_late": F.when(security_relevant(F.col("filename")), 0).otherwise(1),
        "_chars": F.length(file_line()) + 1})
    room = d.groupBy(key).agg(
        (F.lit(context_tokens - RESERVED_TOKENS) - F.ceil((F.sum("_chars") - 1) / 4)).alias("room"),
        F.ceil(F.coalesce(F.sum(F.length("section") + 1) - 1, F.lit(0)) / 4).alias("diff_tokens"))
    if size is not None:
        room = room.drop("diff_tokens").join(size, key, "left").withColumn("diff_tokens", F.ceil(F.coalesce("diff_chars", F.lit(0)) / 4)).drop("diff_chars")
    d = d.join(room, key).withColumn("_whole", F.col("diff_tokens") <= F.col("room"))
    order = [F.col("_late"), F.col("changes"), F.col("file_ord")]
    can = d.filter("not _whole and section is not null and tokens > 0 and tokens <= room").select(
        key, "filename", "tokens", "room", "_late", "changes", "file_ord")
    most = F.floor(F.col("room") / F.col("tokens"))
    salted = can.withColumn("_salt", F.pmod(F.xxhash64("filename"), F.lit(salts)))
    one = Window.partitionBy(key, "tokens", "_salt").orderBy(*order)
    two = Window.partitionBy(key, "tokens").orderBy(*order)
    few = (salted.withColumn("_r", F.row_number().over(one)).filter(F.col("_r") <= most)
           .withColumn("_r", F.row_number().over(two)).filter(F.col("_r") <= most).drop("_r", "_salt"))

    kinds = {f.name: f.dataType.simpleString() for f in few.schema}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_late", "changes", "file_ord"])
        used, keep = 0, []
        room_ = int(pdf["room"].iloc[0])
        for x in pdf["tokens"].to_numpy():
            good = used + x <= room_
            used += int(x) if good else 0
            keep.append(good)
        return pdf[np.array(keep)][[key, "filename"]]

    taken = few.groupBy(key).applyInPandas(fit, f"{key} {kinds[key]}, filename string").withColumn("_in", F.lit(True))
    fate = (F.when(F.col("skipped"), "skipped").when(F.col("_whole"), "whole").when(F.col("_in"), "packed").otherwise("summary"))
    return d.join(taken, [key, "filename"], "left").withColumn("fate", fate).drop("_in", "_whole", "_late", "_chars")


# What stands for omitted files, and names shown in the note.
OMITTED = "\n\n--- Omitted files (summary only) ---\n"
NOTED = 5


def packed_review(packed: DataFrame, sections: DataFrame, key: str = "run_id", noted: int = NOTED) -> DataFrame:
    """(key, diff, truncated, note, skipped, tokens) of reviews from `pack_diff`.

    ``diff`` is the whole remaining diff where it fits, else the packed sections,
    security-relevant and small ones first, and a line for each omitted file.
    What is put together is within the token budget, but for the omitted lines.
    """
    whole = (sections.join(packed.filter("fate = 'whole'").select(key).distinct(), key, "left_semi").groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "section"))), lambda x: x["section"]), "").alias("_whole")))
    omitted = F.concat(F.lit("[diff omitted — too large] "), "filename", F.format_string(" (%s, +%d/-%d lines)", "status", "additions", "deletions"))
    place = F.struct(F.when(security_relevant(F.col("filename")), 0).otherwise(1).alias("late"), F.col("changes").alias("changes"), F.col("file_ord").alias("file_ord"))
    texts = lambda fate, value: F.transform(F.array_sort(F.collect_list(F.when(F.col("fate") == fate, F.struct(place.alias("o"), value.alias("t"))))), lambda x: x["t"])
    # A file without a section has a line among the omitted ones, but is not counted as dropped.
    dropped = F.array_sort(F.collect_list(F.when((F.col("fate") == "summary") & F.col("section").isNotNull(), F.struct(place.alias("o"), F.col("filename").alias("t")))))
    per = packed.groupBy(key).agg(
        texts("packed", F.col("section")).alias("_packed"), texts("summary", omitted).alias("_omitted"), F.transform(dropped, lambda x: x["t"]).alias("_dropped"),
        F.array_sort(F.collect_list(F.when(F.col("section").isNull() & (F.coalesce("patch", F.lit("")) == ""), F.col("filename")))).alias("skipped"),
        F.max("diff_tokens").alias("_all"), F.sum(F.when(F.col("fate") == "packed", F.col("tokens")).otherwise(0)).alias("_used"),
        F.ceil((F.sum(F.length(file_line()) + 1) - 1) / 4).alias("_list"))
    d = per.join(whole, key, "left")
    cut = F.concat(F.array_join("_packed", "\n"), F.when(F.size("_omitted") > 0, F.concat(F.lit(OMITTED), F.array_join("_omitted", "\n"))).otherwise(""))
    n = F.size("_dropped")
    names = F.concat(F.array_join(F.slice("_dropped", 1, noted), ", "), F.when(n > noted, F.concat(F.lit(" and "), (n - noted).cast("string"), F.lit(" more"))).otherwise(""))
    fits = F.col("_whole").isNotNull()
    return d.select(key, F.coalesce("_whole", cut).alias("diff"), (~fits & (n > 0)).alias("truncated"),
                    F.when(~fits & (n > 0), F.concat(F.lit("[TRUNCATED] "), n.cast("string"), F.lit(" file(s) omitted due to context limits: "), names)).alias("note"),
                    "skipped", (F.col("_list") + F.when(fits, F.col("_all")).otherwise(F.col("_used"))).cast("long").alias("tokens"))


# -- repository context -------------------------------------------------------------

def context_lines(edges: DataFrame, tree: DataFrame, notes: DataFrame, max_imports: int = MAX_IMPORTS, max_tree: int = MAX_TREE, shown_tree: int = SHOWN_TREE) -> DataFrame:
    """(repo, section, no, line): capped import edges, tree and diagnostics.

    ``notes`` has (repo, ord, level, message); ``ord`` is the order of arrival.
    """
    shown = first_k(edges.select("repo", "ord", "src", "dst", "symbols", "external"), ["repo"], [F.col("ord")], max_imports, "no")
    clean = text.clean_control
    target = F.when(F.col("external"), F.concat(clean(F.col("dst")), F.lit(" (external)"))).otherwise(clean(F.col("dst")))
    names = F.when(F.size("symbols") > 0, F.concat(F.lit(" (symbols: "), F.array_join(F.transform("symbols", clean), ", "), F.lit(")"))).otherwise("")
    imports = shown.select("repo", F.lit(1).alias("section"), "no", F.concat(F.lit("- "), clean(F.col("src")), F.lit(" → "), target, names).alias("line"))
    size = F.when(F.col("size").isNotNull(), F.concat(F.lit(" ("), F.call_function("format_number", F.col("size") / 1024, F.lit("0.0")), F.lit("KB)"))).otherwise("")
    top = first_k(tree.select("repo", "path", "size"), ["repo"], [F.col("path")], shown_tree, "no")
    entries = top.select("repo", F.lit(2).alias("section"), "no", F.concat(F.lit("- "), clean(F.col("path")), size).alias("line"))
    n_tree = tree.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    more = n_tree.filter(F.col("n") > shown_tree).select("repo", F.lit(2).alias("section"), F.lit(shown_tree + 1).alias("no"), F.concat(
        F.lit("- ... ("), (F.least("n", F.lit(max_tree)) - shown_tree).cast("string"), F.lit(" more files)")).alias("line"))
    n_edges = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    note = lambda df, cap, words: df.filter(F.col("n") > cap).select("repo", F.lit("warn").alias("level"), words.alias("message"))
    extra = note(n_edges, max_imports, F.concat(F.lit(f"Import edges capped at {max_imports} ("), F.col("n").cast("string"), F.lit(" total); some dependencies not shown."))).unionByName(
        note(n_tree, max_tree, F.concat(F.lit(f"Repository tree capped at {max_tree} entries ("), F.col("n").cast("string"), F.lit(" total); some files not shown."))))
    # In order of arrival, the caps last; numbered by range slices, so a noisy repository is spread out.
    said = notes.select("repo", F.lit(0).alias("_o"), "ord", "level", "message").unionByName(
        extra.select("repo", F.lit(1).alias("_o"), F.lit(None).cast(notes.schema["ord"].dataType).alias("ord"), "level", "message"))
    diag = row_positions(said, ["repo"], [F.col(c) for c in ("_o", "ord", "level", "message")], "no").select(
        "repo", F.lit(3).alias("section"), F.col("no").cast("int").alias("no"), F.concat(F.lit("- ["), F.upper("level"), F.lit("] "), "message").alias("line"))
    return imports.unionByName(entries).unionByName(more).unionByName(diag)


# Section titles in order.
TITLES = {1: "## Import Dependencies", 2: "## Repository Structure", 3: "## Diagnostics"}


def fit_context(lines: DataFrame, budget: int) -> DataFrame:
    """Lines that fit: sections in order share one budget; a section that does
    not fit whole is cut at its first overflow.

    A line costs at least one token, so no section shows more than ``budget``
    lines; the rest only counts towards its total length.
    """
    cost = F.ceil((F.length("line") + 1) / 4)
    head = F.length(sev_title(F.col("section")))
    whole = lines.groupBy("repo", "section").agg(F.ceil((F.first(head) + F.sum(F.length("line") + 1)) / 4).alias("full"))
    few = first_k(lines.withColumn("cost", cost), ["repo", "section"], [F.col("no")], budget)
    run = Window.partitionBy("repo", "section").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("run", F.sum("cost").over(run) + F.ceil(head / 4))
    chars = F.sum(F.length("line") + 1).over(run) + head
    few = few.withColumn("chars", chars).join(whole, ["repo", "section"])
    done = None
    used = lines.select("repo").distinct().withColumn("used", F.lit(0).cast("long"))
    for section in TITLES:
        here = few.filter(F.col("section") == section).join(used, "repo").filter(F.col("used") < budget)
        here = cut_lineage(here.filter((F.col("used") + F.col("full") <= budget) | (F.col("used") + F.col("run") <= budget)))
        spent = here.groupBy("repo").agg(F.ceil(F.max("chars") / 4).alias("_t"))
        used = used.join(spent, "repo", "left").select("repo", (F.col("used") + F.coalesce("_t", F.lit(0))).alias("used"))
        part = here.select("repo", "section", "no", "line")
        done = part if done is None else done.unionByName(part)
    return done


def sev_title(section: Column) -> Column:
    return sev_lookup(section, TITLES)


# -- prompts and snippets -------------------------------------------------------------

def numbered_file(path: Column, content: Column) -> Column:
    lines = F.transform(F.split(content, "\n"), lambda l, i: F.concat((i + 1).cast("string"), F.lit(" | "), l))
    return F.concat(F.lit("── "), path, F.lit(" ──\n"), F.array_join(lines, "\n"))


def chunk_prompts(packed: DataFrame, files: DataFrame, budget_tokens: int, target: str, branch: str, hipaa: str = "",
                  order: str = "path", focus: dict[str, str] | None = None) -> DataFrame:
    """One prompt row per chunk, files in the order in which `pack_chunks` placed
    them (same ``order``); a chunk holds at most its token budget of text.
    ``focus`` says what to look for in a domain."""
    limit = int(np.floor(budget_tokens * FILL))
    d = packed.join(files.select("repo", "path", F.col(order).alias("_ord"), "content"), ["repo", "path"]).withColumn(
        "_block", numbered_file(F.col("path"), text.cut_middle(F.col("content"), limit)))
    per = d.groupBy("repo", "domain", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("priority", "_ord", "path", "_block"))).alias("_f"), F.sum("packed_tokens").alias("tokens"))
    wants = F.col("domain").isin("auth", "data-flow", "general") & F.lit(bool(hipaa))
    user = F.concat(
        F.lit(f"## Security Scan Context\n\n**Target:** {target}\n**Branch:** {branch}\n**Domain:** "), "domain",
        F.lit("\n**Chunk:** "), "chunk_id", F.lit("\n**Focus:** "), sev_lookup(F.col("domain"), focus or {"": ""}, ""), F.lit("\n\n## Files to Analyze ("), F.size("_f").cast("string"), F.lit(")\n\n"),
        F.array_join(F.transform("_f", lambda x: F.concat(F.lit("  - "), x["path"])), "\n"),
        F.lit("\n\n## File Contents\n\n"), F.array_join(F.col("_f._block"), "\n\n"),
        # Fixed value: the closing line.
        F.lit("\n\n---\n\nAnalyze these files for "), "domain", F.lit(" security issues. Return your findings as a JSON array."),
        F.when(wants, F.lit(f"\n\n## HIPAA Configuration Context\n{hipaa}")).otherwise(""))
    return per.select("repo", "domain", "chunk_id", "tokens", F.size("_f").alias("n_files"), user.alias("user"))


def lens_prompts(reviews: DataFrame, lenses: DataFrame, requests: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per requested (review, lens); ``requests`` has the key and ``lens``.

    A request for a lens that the catalogue lacks gives no prompt; see
    `lenses.unknown_ids`.
    """
    catalogue = lenses.select(F.col("id").alias("lens"), F.col("system_prompt").alias("system"))
    return (requests.select(key, "lens").distinct().join(catalogue, "lens").join(reviews, key).select(
        key, "lens", "system", F.concat(F.lit("## Changed Files\n"), "file_list", F.lit("\n\n## Diff\n"), "diff").alias("user")))


def snippets(points: DataFrame, files: DataFrame, radius: int = 5) -> DataFrame:
    """Add ``snippet``: lines around ``line`` of ``path``, with a marker.

    The file is met once by (repo, path); the lines are cut inside its row.
    """
    lines = F.split("content", "\n")
    start = F.greatest(F.col("line") - 1 - radius, F.lit(0))
    part = F.slice(lines, start + 1, F.greatest(F.least(F.size(lines), F.col("line") + radius) - start, F.lit(0)))
    marked = F.transform(part, lambda l, i: F.concat(
        F.when(start + i + 1 == F.col("line"), F.lit(">>>")).otherwise(F.lit("   ")), F.lit(" "), (start + i + 1).cast("string"), F.lit(": "), l))
    gone = F.concat(F.lit("(file not available: "), "path", F.lit(")"))
    return (points.join(files.select("repo", "path", "content"), ["repo", "path"], "left")
            .withColumn("snippet", F.when(F.coalesce("content", F.lit("")) == "", gone).otherwise(F.array_join(marked, "\n"))).drop("content"))
