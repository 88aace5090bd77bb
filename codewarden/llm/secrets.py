"""Secret scans with corpus-wide ownership frequency.

Four patterns give candidates: assignments to a credential name, access key
ids, long hexadecimal strings, and long mixed tokens.  The digest of each
candidate's value is counted over distinct owners and distinct repositories of
the whole corpus.  A value that many owners hold is an example that was copied;
one that stays with few owners looks live.  Mixed tokens become spans (kind
``owned``) only where they look live; spans of the first three kinds always stay.
Only DataFrame functions are used; offsets are code points, end exclusive.

* null text: empty; a document without spans gets zero counts and an empty list.
* null owner or repository: counts as one owner or repository named "".
* matches are leftmost and do not overlap within a kind; kinds may overlap.
* repeated rows and ids are scanned row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


@dataclass(frozen=True)
class Kind:
    """``group`` of a match is its value; shorter values than ``least`` are dropped after matching.

    ``gate`` finds texts without any match cheaply.
    """

    name: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 0


KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"(?i)(?:passw|secret|token|api_?key)", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]"),
    Kind("hex", r"[0-9a-f]{32,}", "[0-9a-f]{32}"),
    # Lower and upper case and a digit within one long word.
    Kind("owned", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}",
         "[A-Za-z0-9+/_=-]{20}"),
)
BASE = 3
#: A value of more owners, or of more repositories, is a copied example.
OWNERS, REPOSITORIES = 2, 8


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """Array of (kind, place, gap before, size, value), gaps and sizes in code points."""
    pattern = F.lit(kind.pattern)
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("value"))
    row = lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"),
                                F.length(x["hit"]).alias("size"), x["value"].alias("value"))
    none = F.array().cast("array<struct<kind: int, place: int, gap: int, size: int, value: string>>")
    # There is one gap more than matches.
    return F.when(text.rlike(kind.gate), F.filter(F.transform(parts, row), lambda x: x["size"].isNotNull())).otherwise(none)


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per candidate with its span, one row without span per document that has none.

    Spans come from running sums over the rows of one document and kind.
    """
    body = F.col("_cw_text")
    rows = (docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"),
                        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
                        F.coalesce(F.col(text), F.lit("")).alias("_cw_text"))
            .select("row", "doc_id", "owner", "repository", F.explode_outer(F.concat(*[_matches(body, n, k) for n, k in enumerate(KINDS)])).alias("m"))
            .select("row", "doc_id", "owner", "repository", "m.*"))
    before = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")
    least = F.coalesce(*[F.when(F.col("kind") == n, F.lit(k.least)) for n, k in enumerate(KINDS)], F.lit(0))
    # A document stays on one partition for the sums and for the later list.
    spans = rows.repartition("row").withColumn("start", start.cast("long")).withColumn("end", (start + F.col("size")).cast("long"))
    good = F.col("kind").isNull() | (F.length("value") >= least)
    blank = lambda c: F.when(good, F.col(c)).alias(c)  # noqa: E731  a dropped match leaves a row without span
    return spans.select("row", "doc_id", "owner", "repository", blank("kind"), blank("start"), blank("end"),
                        F.when(good, F.sha2(F.col("value").cast("binary"), 256)).alias("digest"))


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate digest: distinct owners and distinct repositories (an owner's own)."""
    places = found.filter("digest is not null").select("digest", "owner", "repository").distinct()
    return (places.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories")))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id",
         owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """One row per document: ``spans`` (kind, start, end, live) in order of start, then kind."""
    found = cut_lineage(candidates(docs, id_col, text, owner, repository))
    # Written, so that both sides of the join are dealt out by the digest and a hot one can be split.
    known = cut_lineage(ownership(found))
    live = (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    hits = (found.filter("digest is not null").join(known, "digest")
            .select("row", "doc_id", "kind", "start", "end", live.alias("live"))
            .filter(F.col("live") | (F.col("kind") < BASE)))
    # Every document once, also without candidates.
    every = found.groupBy("row", "doc_id").agg(F.lit(None).cast("int").alias("kind"))
    rows = hits.unionByName(every, allowMissingColumns=True)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", "live"))
    return rows.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def labels(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document."""
    def count(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of(number: int) -> Column:
        return count(lambda s: s["kind"] == number).alias(f"n_{KINDS[number].name}")

    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return scanned.select(
        "doc_id", *map(of, range(BASE)),
        F.sha2(labels(base).cast("binary"), 256).alias("base_sha256"), labels(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"))
