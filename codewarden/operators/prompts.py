"""Prompts from templates that are tables: one row per section.

A section has a place, an optional condition, a value with the text around it and
an optional token budget.  Values are joined by name and never read as templates,
so a text that looks like a slot stays what it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.severity import lookup


@dataclass(frozen=True)
class Part:
    """``before``, the value named ``slot`` and ``after``; left out where the value ``when`` is empty or missing.

    Without a slot only ``before`` is written.  A value above ``budget`` tokens is cut in the middle.
    """

    before: str
    slot: str | None = None
    after: str = ""
    when: str | None = None
    budget: int | None = None


# Form of a review prompt.
REVIEW = (
    Part("PR #", "number", ": "), Part("", "title", "\n"), Part("Repository: ", "repository", "\n"), Part("Author: ", "author", "\n"),
    Part("Base branch: ", "base", " ← "), Part("", "head", "\n"), Part("Labels: ", "labels", "\n"),
    Part("Stats: +", "additions", " additions / -"), Part("", "deletions", " deletions\n"), Part("", "warnings", "\n", when="warnings"),
    Part("\n## PR Description\n", "body", "\n"), Part("\n## Changed Files (", "n_files", " files)\n"), Part("", "file_list", "\n"),
    Part("\n⚠️ ", "note", "\n", when="note"), Part("\n## Diff\n", "diff"),
    Part("\n\n## HIPAA Configuration Context\n", "hipaa", when="hipaa"), Part("\n\n## Codebase Context\n", "codebase", when="codebase"),
)
# What a review is told about the state of its request, and stand-ins for missing texts.
DRAFT, MERGED, CLOSED = "⚠️ This is a DRAFT PR.", "ℹ️ This PR is already merged.", "ℹ️ This PR is closed."
NO_LABELS, NO_BODY = "(none)", "(no description provided)"
ANSWER_FORM = (
    "Answer with a JSON array and nothing else. Each finding has id, severity (CRITICAL, HIGH, MEDIUM, LOW or INFO), category, "
    "location (file:line or general), summary, detail and suggestion. Without findings answer [].")


def template(spark, parts: tuple[Part, ...], name: str = "review") -> DataFrame:
    """A template as a table: (template, no, before, slot, after, when, budget)."""
    return spark.createDataFrame([(name, i, p.before, p.slot, p.after, p.when, p.budget) for i, p in enumerate(parts)],
                                 "template string, no int, before string, slot string, after string, when string, budget int")


def assemble(requests: DataFrame, templates: DataFrame, keys: list[str], values: str = "values", name: str = "template") -> DataFrame:
    """(keys, text) of every request; ``requests`` has the keys, ``template`` and a map of ``values``.

    The sections of a request meet in one row at the end; until then a row holds
    one value, so a long diff is not copied for each section.
    """
    named = requests.select(*keys, name, F.explode(values).alias("slot", "value"))
    full = requests.select(*keys, name, F.map_keys(F.map_filter(values, lambda k, v: F.coalesce(v, F.lit("")) != "")).alias("_full"))
    wanted = full.join(templates, name).filter(F.col("when").isNull() | F.array_contains("_full", F.col("when"))).drop("_full")
    value = F.coalesce("value", F.lit(""))
    cut = F.when(F.col("budget").isNull(), value).otherwise(text.cut_middle(value, F.col("budget")))
    parts = wanted.join(named, [*keys, name, "slot"], "left").select(*keys, "no", F.concat("before", F.when(F.col("slot").isNull(), "").otherwise(cut), "after").alias("part"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda x: x["part"]), "").alias("text"))


def state_warnings(draft: Column, state: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(draft, DRAFT), F.when(state == "merged", MERGED), F.when(state == "closed", CLOSED))), "\n")


def review_prompts(reviews: DataFrame, lenses: DataFrame, hipaa: DataFrame | None = None, codebase: DataFrame | None = None,
                   parts: tuple[Part, ...] = REVIEW, key: str = "run_id") -> DataFrame:
    """(key, lens, system, user) for every review and each of its resolved ``lenses``, see `lenses.resolve`.

    ``reviews`` has number, title, repository, author, base, head, labels (array),
    additions, deletions, draft, state, body, n_files, file_list, note and diff;
    ``hipaa`` and ``codebase`` have (key, block), the former for the lens ``hipaa`` only.
    """
    d = reviews
    for name, block in (("hipaa", hipaa), ("codebase", codebase)):
        d = d.withColumn(f"_{name}", F.lit("")) if block is None else d.join(block.select(key, F.col("block").alias(f"_{name}")), key, "left")
    labels = F.when(F.size("labels") > 0, F.array_join("labels", ", ")).otherwise(NO_LABELS)
    plain = ["number", "title", "repository", "author", "base", "head", "additions", "deletions", "n_files", "file_list", "diff"]
    pairs = [x for c in plain for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    pairs += [F.lit("labels"), labels, F.lit("warnings"), state_warnings(F.col("draft"), F.col("state")), F.lit("note"), F.coalesce("note", F.lit("")),
              F.lit("body"), F.coalesce(F.nullif("body", F.lit("")), F.lit(NO_BODY)), F.lit("codebase"), F.coalesce("_codebase", F.lit(""))]
    wants = d.join(lenses.select(key, "lens", "system_prompt"), key)
    own = F.when(F.col("lens") == "hipaa", F.coalesce("_hipaa", F.lit(""))).otherwise("")
    asked = wants.select(key, "lens", F.lit("review").alias("template"), F.create_map(*pairs, F.lit("hipaa"), own).alias("values"))
    user = assemble(asked, template(reviews.sparkSession, parts), [key, "lens"])
    system = lenses.select(key, "lens", F.concat("system_prompt", F.lit("\n\n" + ANSWER_FORM)).alias("system"))
    return system.join(user.withColumnRenamed("text", "user"), [key, "lens"])


# Titles of the block for the lens hipaa, and what stands between title and items.
CONTEXT = {
    1: "## BAA Registry\n\nThese services have signed a Business Associate Agreement (BAA):",
    2: "\nThese services have NO BAA; PHI must not be sent to them:",
    3: ("\n**Rules:**\n- Report PHI sent to a service without a BAA as HIGH or CRITICAL.\n"
        "- Report a service that is in neither list as unknown BAA status, MEDIUM.\n- PHI may go to covered services if it is encrypted on the way."),
    4: "\n## Project-Specific PHI Fields\n\nBesides the standard fields watch for these:",
    5: "\n## PHI Source Files\n\nFiles that match these patterns handle PHI:",
}


def context_block(registry: DataFrame, fields: DataFrame | None = None, sources: DataFrame | None = None, key: str = "run_id") -> DataFrame:
    """(key, block): agreements, configured fields and source patterns as text.

    ``registry`` has (key, pattern, status), ``fields`` (key, field, ord) without
    the defaults, ``sources`` (key, pattern, ord).  Sections 4 and 5 are left out
    where they are empty; services are listed in the order of their names.
    """
    rows = registry.select(key, F.when(F.col("status") == "covered", 1).otherwise(2).alias("section"), F.lit(0).cast("long").alias("ord"), F.concat(
        F.lit("- "), text.clean_domain(F.col("pattern"))).alias("line"))
    for section, table, column in ((4, fields, "field"), (5, sources, "pattern")):
        if table is not None:
            rows = rows.unionByName(table.select(key, F.lit(section).alias("section"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("- `"), column, F.lit("`")).alias("line")))
    parts = rows.groupBy(key, "section").agg(F.concat(F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "line"))), lambda x: x["line"]), "\n")).alias("lines"))
    always = rows.select(key).distinct().select(key, F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)])).alias("section"))
    shown = always.unionByName(parts.filter("section > 3").select(key, "section")).join(parts, [key, "section"], "left")
    piece = F.concat(lookup(F.col("section"), CONTEXT), F.coalesce("lines", F.lit("")))
    return shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", piece.alias("piece")))), lambda x: x["piece"]), "\n").alias("block"))
