"""Near-duplicate merging: the order-dependent greedy merges and model votes.

A greedy merge is sequential by definition, but findings that can never meet
do not influence each other.  Each merge is therefore cut into *islands* that
provably do not interact - by word-set similarity or by line distance - and
only the order of absorption inside an island is decided by a fold that streams.
The fold sees four narrow columns and remembers groups and distinct rows; the
merge of texts and lens lists is an aggregate in the JVM.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text
from ..session import cut_lineage
from .findings import merge_exact
from .ordered import ordered_union
from .similarity import components, set_key, similar_sets

# Similarity limits and line distance of the merges.
REVIEW_OVER = 0.8
SCAN_FROM = 0.5
VOTE_OVER = 0.7
LINE_REACH = 5


# -- islands -----------------------------------------------------------------------

def word_islands(findings: DataFrame, keys: list[str], words: Column, threshold: float, strict: bool) -> DataFrame:
    """Add ``island``: findings of one group linked by similar word sets.

    Copies of a word set are one node, so heavy repetition costs one vertex.
    """
    # A vertex is known by a 256-bit digest of its group and words.
    d = findings.withColumn("_words", words).withColumn("_node", _vertex(*keys, set_key(F.col("_words"))))
    # Vertices are read by several joins; they are narrow and free of copies.
    nodes = cut_lineage(d.groupBy(*keys, "_node").agg(F.first("_words").alias("words")).withColumnRenamed("_node", "id"))
    pairs = similar_sets(nodes, keys, threshold, strict)
    labels = components(nodes.select("id"), pairs)
    return (d.join(labels.withColumnRenamed("id", "_node"), "_node")
            .withColumnRenamed("comp", "island").drop("_words", "_node"))


def _vertex(*parts) -> Column:
    """Digest of named parts; unlike a 64-bit hash it does not collide at any size."""
    return F.sha2(F.to_json(F.struct(*[(F.col(p) if isinstance(p, str) else p).alias(f"p{i}") for i, p in enumerate(parts)])).cast("binary"), 256)


def line_islands(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``island``: runs of lines of one file and category with gaps of at
    most five.  Distinct lines are few (a file has a bounded number of lines),
    so the window never sees the copies.  No line: ``island`` is null."""
    group = [*keys, "file_key", "category"]
    d = findings.withColumns({"file_key": text.file_key(F.col("location")),
                              "line_key": text.line_lenient(F.col("location"))})
    lines = d.filter("line_key is not null").groupBy(*group, "line_key").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("line_key")
    starts = lines.withColumn("_new", F.coalesce((F.col("line_key") - F.lag("line_key").over(w) > LINE_REACH).cast("int"), F.lit(1)))
    runs = starts.withColumn("island", F.sum("_new").over(w)).drop("_new", "_n")
    return d.join(runs, [*group, "line_key"], "left")


# -- the folds ---------------------------------------------------------------------

class Greedy:
    """Rows of one island in order; each goes to the first earlier group that accepts it.

    Whether a group accepts a row depends on the group's *state* only, so groups
    are kept by state: a row asks every distinct state once, remembers the
    answers, and takes the earliest group of the accepted ones.  A copy of an
    earlier row costs a few dictionary look-ups, and memory holds the groups and
    distinct rows, not the findings.
    """

    def __init__(self, accepts, absorb, near=None):
        self.accepts, self.absorb, self.near = accepts, absorb, near
        self.number: dict = {}  # state -> its number
        self.states: list = []
        self.members: list[list[int]] = []  # per state: heap of groups that are or were in it
        self.at = array("q")  # per group: its present state
        self.first, self.joined, self.led = array("q"), array("q"), array("q")
        self.answers: dict = {}  # row -> [states asked, states that accept]

    def _enter(self, group: int, state) -> None:
        i = self.number.setdefault(state, len(self.states))
        if i == len(self.states):
            self.states.append(state)
            self.members.append([])
        self.at[group] = i
        heapq.heappush(self.members[i], group)

    def _earliest(self, i: int) -> int | None:
        heap = self.members[i]
        while heap and self.at[heap[0]] != i:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def _accepting(self, row) -> list[int]:
        if self.near:
            return [i for s in self.near(row) if (i := self.number.get(s)) is not None]
        asked = self.answers.setdefault(row, [0, []])
        asked[1] += [i for i in range(asked[0], len(self.states)) if self.accepts(self.states[i], row)]
        asked[0] = len(self.states)
        return asked[1]

    def add(self, ord_: int, row) -> tuple[int, int]:
        """(ord of the group's first row, place in the group): the smallest place is the group's base."""
        groups = [g for i in self._accepting(row) if (g := self._earliest(i)) is not None]
        if not groups:
            for column, value in ((self.at, 0), (self.first, ord_), (self.joined, 0), (self.led, 0)):
                column.append(value)
            self._enter(len(self.first) - 1, row)
            return ord_, 0
        g = min(groups)
        before = self.states[self.at[g]]
        state, leads = self.absorb(before, row)
        if state != before:
            self._enter(g, state)
        column = self.led if leads else self.joined
        column[g] += 1
        return self.first[g], -column[g] if leads else column[g]


def _overlap(a: frozenset, b: frozenset, empty: float) -> float:
    both = len(a & b)
    either = len(a) + len(b) - both
    return both / either if either else empty


def review_fold() -> Greedy:
    """State and row: (rank, words).  A group takes over the more severe rank."""
    return Greedy(lambda s, r: abs(s[0] - r[0]) <= 1 and _overlap(s[1], r[1], 1.0) > REVIEW_OVER,
                  lambda s, r: ((min(s[0], r[0]), s[1]), False))


def line_fold() -> Greedy:
    """State and row: (line, deterministic).  A deterministic finding takes over
    as the anchor; later matches go to it rather than being lost."""
    return Greedy(None, lambda s, r: (r, True) if r[1] and not s[1] else (s, False),
                  near=lambda r: [(line, d) for line in range(r[0] - LINE_REACH, r[0] + LINE_REACH + 1) for d in (False, True)])


def domain_fold() -> Greedy:
    """State and row: (lenses, words, deterministic); the lens sets must differ."""
    def absorb(s, r):
        lenses = s[0] | r[0]
        return ((lenses, r[1], True), True) if r[2] and not s[2] else ((lenses, *s[1:]), False)

    return Greedy(lambda s, r: s[0] != r[0] and _overlap(s[1], r[1], 0.0) >= SCAN_FROM, absorb)


def _fold_islands(rows: DataFrame, keys: list[str], columns: list[str], fold, row) -> DataFrame:
    """Run a fold over every island; islands arrive sorted and stream through.

    ``row`` makes the fold's row from the columns.  A partition holds many
    islands; only the groups of one are in memory.
    """
    schema = rows.select(*keys, "ord", F.col("ord").alias("anchor"), F.lit(0).alias("seq")).schema
    narrow = rows.select(*keys, "ord", *columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, groups = None, None
        for pdf in batches:
            done = []
            for rec in pdf.itertuples(index=False, name=None):
                k, ord_ = rec[:len(keys)], rec[len(keys)]
                if k != key:
                    key, groups = k, fold()
                done.append((*k, ord_, *groups.add(ord_, row(*rec[len(keys) + 1:]))))
            if done:
                yield pd.DataFrame(done, columns=schema.names)

    # By a hash of the keys: Spark drops a repartition by the keys that a join below has
    # dealt by already, and may then read that join's shuffle locally, which tears islands apart.
    return (narrow.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "ord").mapInPandas(run, schema))


def _apply(findings: DataFrame, anchors: DataFrame, keys: list[str], scan: bool) -> DataFrame:
    """Merge every finding into its anchor; aggregates only."""
    d = findings.join(anchors.select(*keys, "ord", "anchor", "seq"), [*keys, "ord"], "left").withColumns({
        "anchor": F.coalesce("anchor", "ord"), "seq": F.coalesce("seq", F.lit(0))})
    group = [*keys, "anchor"]
    fixed = {"severity", "lenses", "detail", "suggestion", "deterministic", "score", "anchor", "seq", *keys}
    rest = [c for c in findings.columns if c not in fixed or (not scan and c in ("suggestion", "deterministic", "score"))]
    rest = [c for c in rest if c not in keys]
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col("seq")))
    aggs = [F.min_by(F.struct(*rest), "seq").alias("_base"),
            F.min(sev.rank(F.col("severity"))).alias("_rank"), longest("detail").alias("detail"),
            F.count(F.lit(1)).alias("merged_from")]
    if scan:
        aggs += [longest("suggestion").alias("suggestion"),
                 F.bool_or(F.coalesce("deterministic", F.lit(False))).alias("deterministic"),
                 F.min_by("score", "seq").alias("_score")]
    merged = d.groupBy(*group).agg(*aggs)
    lenses = ordered_union(d, group, F.col("lenses"), F.col("seq"), "lenses")
    out = merged.join(lenses, group, "left").withColumn("severity", sev.from_rank(F.col("_rank")))
    if scan:
        out = out.withColumn("score", F.when(
            F.col("deterministic") & (F.col("merged_from") > 1), 100).otherwise(F.col("_score"))).drop("_score")
    return out.select(*keys, "severity", "_base.*", "detail", "lenses", "merged_from",
                      *(["suggestion", "deterministic", "score"] if scan else []))


# -- merges ------------------------------------------------------------------------

def review_dedup(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Exact copies first, then same file, adjacent severity, similar summary."""
    exact = cut_lineage(merge_exact(findings, keys).drop("copies"))
    d = exact.withColumns({"file_key": text.file_key(F.col("location")), "rank": sev.rank(F.col("severity")),
                           "words": text.words_key(F.col("summary"))})
    group = [*keys, "file_key"]
    isl = word_islands(d, group, F.col("words"), REVIEW_OVER, strict=True)
    busy = _busy(isl, [*group, "island"])
    anchors = _fold_islands(busy, [*group, "island"], ["rank", "words"], review_fold, lambda r, w: (r, frozenset(w)))
    return _apply(exact, anchors, keys, scan=False)


def _busy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of islands with at least two members; the rest need no fold."""
    many = df.filter(F.col("island").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    return df.join(many, keys, "left_semi")


def scan_dedup(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Same category within five lines, then similar summaries across domains."""
    near = line_islands(findings, keys)
    group = [*keys, "file_key", "category", "island"]
    busy = _busy(near, group)
    lines = _fold_islands(busy, group, ["line_key", "deterministic"], line_fold, lambda ln, d: (int(ln), d is True or d == 1))
    first = _apply(findings, lines, keys, scan=True)
    first = cut_lineage(first.drop("merged_from"))
    d = first.withColumns({"file_key": text.file_key(F.col("location")), "words": text.words_raw(F.col("summary"))})
    group2 = [*keys, "file_key"]
    isl = word_islands(d, group2, F.col("words"), SCAN_FROM, strict=False)
    busy2 = _busy(isl, [*group2, "island"])
    anchors = _fold_islands(busy2, [*group2, "island"], ["lenses", "words", "deterministic"], domain_fold,
                            lambda ls, w, d: (frozenset(ls), frozenset(w), d is True or d == 1))
    return _apply(first, anchors, keys, scan=True)


def vote(findings: DataFrame, keys: list[str], threshold: float = VOTE_OVER) -> DataFrame:
    """Transitive groups of similar findings across models, merged.

    Same file, severities at most one apart, similar summary.  A finding that
    was merged before brings its own ``models`` along.  Summaries are
    compared once per distinct word set of a file.  A set that occurs at
    neighbouring severities is one vertex per unbroken *span* of severities,
    and two similar sets are linked where their spans touch.
    """
    d = findings.withColumns({"file_key": text.file_lower(F.col("location")), "rank": sev.rank(F.col("severity")),
                              "_words": text.words_plain(F.col("summary"))}).withColumn("_set", set_key(F.col("_words")))
    group = [*keys, "file_key"]
    d = d.withColumn("_sources", F.coalesce(F.col("models"), F.array()) if "models" in findings.columns else F.array().cast("array<string>"))
    d = d.withColumn("_id", _vertex(*group, "_set"))
    sets = cut_lineage(d.groupBy(*group, F.col("_id").alias("id")).agg(
        F.first("_words").alias("words"), F.array_sort(F.collect_set("rank")).alias("_ranks"))
        .withColumn("spans", _spans(F.col("_ranks"))))
    pairs = similar_sets(sets.select(*group, "id", "words"), group, threshold, strict=True).select("a", "b")
    ends = sets.select("id", "spans")
    linked = (pairs.join(ends.withColumnsRenamed({"id": "a", "spans": "_x"}), "a")
              .join(ends.withColumnsRenamed({"id": "b", "spans": "_y"}), "b")
              .select("a", "b", F.explode_outer("_x").alias("x"), "_y").select("a", "b", "x", F.explode_outer("_y").alias("y"))
              .filter("x.lo <= y.hi + 1 and y.lo <= x.hi + 1"))
    vertex = lambda i, span: F.concat(i, F.lit(":"), span["lo"].cast("string"))
    flat = sets.select("id", F.explode_outer("spans").alias("s"))
    labels = components(flat.select(vertex(F.col("id"), F.col("s")).alias("id")), linked.select(
        vertex(F.col("a"), F.col("x")).alias("a"), vertex(F.col("b"), F.col("y")).alias("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    spans = flat.select(F.col("id").alias("_id"), "s", vertex(F.col("id"), F.col("s")).alias("id")).join(labels, "id").select("_id", "s", "comp")
    d = d.join(spans, "_id").filter("rank between s.lo and s.hi")
    cluster = [*keys, "comp"]
    rest = [c for c in findings.columns if c not in (*keys, "severity", "lenses", "model", "models")]
    merged = d.groupBy(*cluster).agg(
        F.max_by(F.struct(*rest), F.struct(F.length("detail"), -F.col("ord"))).alias("_best"),
        F.min("rank").alias("_rank"), F.count(F.lit(1)).alias("merged_from"), F.min("ord").alias("first_ord"),
        F.array_sort(F.array_distinct(F.concat(F.collect_set("model"), F.flatten(F.collect_set("_sources"))))).alias("models"))
    lenses = ordered_union(d, cluster, F.col("lenses"), F.col("ord"), "lenses")
    return (merged.join(lenses, cluster, "left").withColumn("severity", sev.from_rank(F.col("_rank")))
            .select(*keys, "severity", "_best.*", "lenses", "models", F.size("models").alias("agreement"),
                    "merged_from", "first_ord"))


def _spans(ranks: Column) -> Column:
    """Unbroken runs of a sorted rank array: array<struct<lo, hi>>."""
    empty = F.array().cast("array<struct<lo:int,hi:int>>")

    def add(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(last["lo"].alias("lo"), r.alias("hi")))
        fresh = F.array_append(acc, F.struct(r.alias("lo"), r.alias("hi")))
        return F.when(F.size(acc) == 0, F.array(F.struct(r.alias("lo"), r.alias("hi")))).when(
            F.try_element_at(acc, F.lit(-1))["hi"] + 1 == r, grown).otherwise(fresh)

    return F.aggregate(ranks, empty, add)


def by_strategy(merged: DataFrame, strategy: str, models: int) -> DataFrame:
    """Optional agreement filter: any (default), majority or unanimous."""
    a = F.col("agreement")
    keep = {"any": F.lit(True), "majority": a * 2 > models, "unanimous": a == models}[strategy]
    return merged.filter(keep)
