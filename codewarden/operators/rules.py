"""Line-rule engine: every enabled rule in one map-only pass over the files.

A rule set never explodes a file into a line table.  Per file, a cheap literal
gate decides whether anything can match; the lines are then filtered inside
the row (higher-order functions), and only *hit* lines, each with its own
window of neighbours, become rows.  There is no shuffle, no join and no group,
so the skew of repositories or paths does not matter, and adding a rule adds an
expression rather than another scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import PHI_FIELDS, PHI_PATH_WORDS
from ..functions.jsregex import glob, js

#: Neighbouring lines kept on each side of a hit.
REACH = 20


@dataclass(frozen=True)
class RuleOptions:
    """Overlays a caller may set; the defaults reproduce the stock rules."""

    phi_fields: tuple[str, ...] = ()
    phi_paths: tuple[str, ...] = ()
    skip_tests: bool = True
    disabled: frozenset[str] = frozenset()
    lenses: tuple[str, ...] = ("hipaa",)

    @property
    def fields(self) -> list[str]:
        """Default fields, then configured ones, without repeats."""
        return list(dict.fromkeys([*PHI_FIELDS, *self.phi_fields]))


@dataclass(frozen=True)
class Hit:
    """What a rule sees of one candidate line."""

    path: Column
    line: Column
    near: Column  # array of lines from REACH before to REACH after
    at: Column  # 0-based index of the line in ``near``
    flags: dict[str, Column] = field(default_factory=dict)

    def window(self, before: int, after: int) -> Column:
        start = F.greatest(self.at - before, F.lit(0))
        return F.slice(self.near, start + 1, self.at - start + 1 + after)

    def close(self, before: int, after: int, test: Callable[[Column], Column]) -> Column:
        """Does any line from ``before`` above to ``after`` below pass?"""
        return F.exists(self.window(before, after), test)

    def above(self, n: int, test: Callable[[Column], Column]) -> Column:
        start = F.greatest(self.at - n, F.lit(0))
        return F.exists(F.slice(self.near, start + 1, self.at - start), test)

    def offset(self, n: int) -> Column:
        """A single neighbour, null outside the file."""
        return F.try_element_at(self.near, F.when(self.at + n + 1 > 0, self.at + n + 1))


@dataclass(frozen=True)
class Scanner:
    """A pluggable rule set: ``emit`` yields arrays of findings (null = none).

    ``literals`` are lower-case strings one of which every triggering line has.
    ``flags`` are file-level facts computed from the whole content; ``values``
    are facts of a hit line that several findings use (evaluated once, in a
    projection of their own).
    """

    id: str
    name: str
    applies: Callable[[Column, RuleOptions], Column]
    literals: tuple[str, ...]
    emit: Callable[[Hit, dict[str, Column]], Iterable[Column]]
    values: Callable[[Hit, RuleOptions], dict[str, Column]] = lambda hit, opts: {}
    flags: Callable[[Column, Column, RuleOptions], dict[str, Column]] = lambda path, content, opts: {}
    whole: Callable[[Column, Column, RuleOptions], Column] | None = None


def finding(when: Column, severity: str | Column, category: str, summary: Column | str,
            detail: Column | str, suggestion: Column | str, regulation: str) -> Column:
    def text(x):
        return x if isinstance(x, Column) else F.lit(x)

    body = F.struct(text(severity).alias("severity"), F.lit(category).alias("category"),
                    text(summary).alias("summary"), text(detail).alias("detail"),
                    text(suggestion).alias("suggestion"), F.lit(regulation).alias("regulation"))
    return F.when(when, body)


def one(*args) -> Column:
    """At most one finding, as an array."""
    return F.array(finding(*args))


def any_literal(text: Column, literals: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in literals])


def mentions(text: Column, literals: Iterable[str]) -> Column:
    """``any_literal`` that evaluates its text once, also after push-down."""
    return F.exists(F.array(text), lambda t: any_literal(t, literals))


def one_of(text: Column, words: Iterable[str]) -> Column:
    return mentions(F.lower(text), words)


def phi_path(path: Column, opts: RuleOptions) -> Column:
    """Health-data path: a keyword, or a configured un-anchored glob."""
    hit = one_of(path, PHI_PATH_WORDS)
    for g in opts.phi_paths:
        hit = hit | path.rlike(glob(g, anchored=False, dots_literal=False))
    return hit


TEST_PATH = {
    # What each scanner family counts as a test file.
    "default": js(r"(?:\.test\.[tj]sx?|\.spec\.[tj]sx?|__tests__\/)"),
    "http": js(r"\.(test|spec)\.[jt]sx?$|\/__tests__\/"),
    "hl7": js(r"(?:\.test\.|\.spec\.|__tests__|__mocks__|\/test\/|\/tests\/|\.stories\.)"),
}
SCRIPT_PATH = js(r"\.[tj]sx?$")


def not_test(path: Column, family: str, opts: RuleOptions) -> Column:
    return ~path.rlike(TEST_PATH[family]) if opts.skip_tests else F.lit(True)


_TEXT_HIT = ("struct<scanner_id:string,rule_no:int,f:struct<severity:string,category:string,summary:string,"
             "detail:string,suggestion:string,regulation:string>>")


def scan_files(files: DataFrame, scanners: Iterable[Scanner], opts: RuleOptions | None = None) -> DataFrame:
    """Findings of all enabled scanners; keeps every column but ``content``.

    ``files`` needs ``path`` and ``content`` (null content is skipped).
    """
    opts = opts or RuleOptions()
    chosen = [s for s in scanners if s.id not in opts.disabled]
    keep = [c for c in files.columns if c != "content"]
    line_rules = [s for s in chosen if s.whole is None]
    text_rules = [s for s in chosen if s.whole is not None]

    def gates(low: Column) -> Column:
        return F.struct(*[
            (s.applies(F.col("path"), opts) & (any_literal(low, s.literals) if s.literals else F.lit(True)))
            .alias(s.id) for s in chosen])

    # The gates are produced by a generator on purpose: it lower-cases the text
    # once and keeps the filter from being pushed below and re-evaluated.
    d = (files.filter(F.col("content").isNotNull())
         .select(*keep, "content", F.explode_outer(F.transform(F.array(F.lower("content")), gates)).alias("_g"))
         .filter(reduce(lambda a, b: a | b, [F.col("_g")[s.id] for s in chosen])))
    on = {s.id: F.col("_g")[s.id] for s in chosen}
    flags = {f"_{s.id}_{name}": F.when(on[s.id], value)
             for s in chosen for name, value in s.flags(F.col("path"), F.col("content"), opts).items()}
    if flags:
        d = d.withColumns(flags)

    no_text = F.lit(None).cast(_TEXT_HIT)

    def hit(line: Column, i: Column) -> Column:
        wanted = F.exists(F.array(F.lower(line)), lambda low: reduce(
            lambda a, b: a | b, [on[s.id] & any_literal(low, s.literals) for s in line_rules], F.lit(False)))
        start = F.greatest(i - REACH, F.lit(0))
        return F.when(wanted, F.struct(
            (i + 1).alias("line_no"), line.alias("line"), (i - start).alias("at"),
            F.slice(F.col("_lines"), start + 1, i - start + 1 + REACH).alias("near"), no_text.alias("text")))

    def text_hits(s: Scanner) -> Column:
        """Findings of a whole-text rule travel as hits that no line rule sees."""
        base = chosen.index(s) * 100
        return F.when(on[s.id], F.transform(s.whole(F.col("path"), F.col("content"), opts), lambda w: F.struct(
            w["line_no"].cast("int").alias("line_no"), F.lit("").alias("line"), F.lit(0).alias("at"),
            F.array().cast("array<string>").alias("near"),
            F.struct(F.lit(s.id).alias("scanner_id"), (w["rule"] + base).alias("rule_no"), w["f"].alias("f")).cast(_TEXT_HIT).alias("text"))))

    flag_cols = ["_g", *flags]
    found = [F.filter(F.transform("_lines", hit), lambda x: x.isNotNull())] if line_rules else []
    found = F.flatten(F.array_compact(F.array(*found, *[text_hits(s) for s in text_rules])))
    # explode_outer, not explode: Spark would otherwise infer a size filter
    # below the generator and evaluate every array twice.
    hits = (d.withColumn("_lines", F.split("content", "\n"))
            .select(*keep, *flag_cols, F.explode_outer(found).alias("h"))
            .filter(F.col("h").isNotNull())
            .select(*keep, *flag_cols, "h.*"))
    views = {s.id: Hit(F.col("path"), F.col("line"), F.col("near"), F.col("at"),
                       {c[len(f"_{s.id}_"):]: F.col(c) for c in flag_cols if c.startswith(f"_{s.id}_")})
             for s in line_rules}
    values = {s.id: s.values(views[s.id], opts) for s in line_rules}
    derived = {f"_v_{i}_{k}": F.when(on[i], v) for i, named in values.items() for k, v in named.items()}
    if derived:
        hits = hits.withColumns(derived)
    made = [F.when(F.col("text").isNotNull(), F.array(F.struct(
        F.col("line_no").alias("line_no"), F.col("text.scanner_id").alias("scanner_id"),
        F.col("text.rule_no").alias("rule_no"), F.col("text.f").alias("f"))))]
    for s in line_rules:
        named = {k: F.col(f"_v_{s.id}_{k}") for k in values[s.id]}
        for m, body in enumerate(s.emit(views[s.id], named)):
            made.append(F.when(on[s.id] & F.col("text").isNull(), _tagged(body, s.id, chosen.index(s) * 100 + m)))
    out = hits.select(*keep, F.explode_outer(F.flatten(F.array_compact(F.array(*made)))).alias("r")).filter(F.col("r").isNotNull())
    location = F.concat_ws(":", "path", F.col("r.line_no").cast("string"))
    return out.select(
        *keep, F.col("r.line_no").cast("int").alias("line_no"),
        deterministic_id(F.col("r.scanner_id"), location).alias("id"),
        F.col("r.f.severity").alias("severity"), F.col("r.f.category").alias("category"),
        location.alias("location"), F.col("r.f.summary").alias("summary"),
        F.col("r.f.detail").alias("detail"), F.col("r.f.suggestion").alias("suggestion"),
        F.array(*[F.lit(x) for x in opts.lenses]).alias("lenses"), F.lit(100).alias("confidence"),
        F.lit(True).alias("deterministic"), F.col("r.scanner_id").alias("scanner_id"),
        F.col("r.f.regulation").alias("regulation"), F.col("r.rule_no").alias("rule_no"))


def _tagged(found: Column, scanner_id: str, rule_no: int) -> Column:
    return F.transform(
        F.filter(found, lambda x: x.isNotNull()),
        lambda x: F.struct(F.col("line_no").alias("line_no"), F.lit(scanner_id).alias("scanner_id"), F.lit(rule_no).alias("rule_no"), x.alias("f")))


def deterministic_id(scanner_id: Column, location: Column) -> Column:
    """Stable id: scanner, then 40 characters of the cleaned location."""
    return F.concat_ws("-", scanner_id, F.left(F.regexp_replace(location, "[^a-zA-Z0-9]", "-"), F.lit(40)))
