"""Similarity join on word sets and connected components, both skew-aware."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..session import cut_lineage


#: A word of more sets than this in a group is met together with a second one.
HOT = 64


def similar_sets(nodes: DataFrame, keys: list[str], threshold: float, strict: bool, hot: int = HOT) -> DataFrame:
    """Pairs (``a`` < ``b``) of different word sets of one group above a threshold.

    ``nodes`` has the group keys, ``id`` and ``words`` (distinct words), one row
    per *distinct* set - copies are collapsed by the caller, so a group of
    copies contributes one node.
    """
    score = jaccard(F.col("wa"), F.col("wb"))
    return candidates(nodes, keys, threshold, hot).filter(score > threshold if strict else score >= threshold).select(*keys, "a", "b")


def candidates(nodes: DataFrame, keys: list[str], threshold: float, hot: int = HOT) -> DataFrame:
    """(keys, a, b, wa, wb): pairs that may be above the threshold, each once.

    With words ordered rarest first in the group, two sets above the threshold
    share a word among their first ``|s| - ceil(t|s|) + 1``, and two words among
    one more than that unless one of the sets is a single word.  So pairs meet in
    equi-joins that Spark can split, never as all pairs of a group: on a word
    that few sets have, and on two words where the rarest one they share is in
    more than ``hot`` sets - then all that they share are.  A single hot word
    meets the sets that are small enough for it; there is one such set.  A pair
    whose sizes or positions leave too little to share is dropped unscored.
    """
    flat = nodes.select(*keys, "id", F.size("words").alias("n"), F.explode("words").alias("w"))
    freq = flat.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("df"))
    ranked = (flat.join(freq, [*keys, "w"]).groupBy(*keys, "id").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o")))
    least = F.ceil(F.col("n") * F.lit(threshold) - 1e-9)
    first = lambda more: F.slice("o", F.lit(1), F.least(F.col("n") - least + more, F.col("n")).cast("int"))
    words = lambda rows: F.transform(rows, lambda x: x["w"])
    sets = cut_lineage(ranked.select(
        *keys, "id", "n", words(F.col("o")).alias("words"), words(F.filter(first(1), lambda x: x["df"] <= hot)).alias("cold"),
        words(F.filter(first(2), lambda x: x["df"] > hot)).alias("warm")))

    def sides(rows: DataFrame, on: list[str], more: list[str]) -> tuple[DataFrame, DataFrame]:
        return tuple(rows.select(*keys, *on, F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("words").alias(f"w{x}"), *[F.col(c).alias(f"{c}_{x}") for c in more]) for x in "ab")

    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - 1e-9
    # A word that occurs in one set of the group pairs with nothing.
    rare = sets.select("*", F.explode("cold").alias("w"))
    several = rare.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    a, b = sides(rare.join(several, [*keys, "w"], "left_semi"), ["w"], ["cold"])
    rest = lambda x: F.col(f"n{x}") - F.array_position(f"w{x}", F.col("w")) + 1
    enough = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    # The pair meets at each rare word that both have; the first one by name counts.  Where it stands bounds what follows.
    one = F.array_min(F.array_intersect("cold_a", "cold_b")) == F.col("w")
    earlier = F.size(F.array_intersect(F.slice("wa", F.lit(1), (F.col("na") - rest("a")).cast("int")), F.slice("wb", F.lit(1), (F.col("nb") - rest("b")).cast("int"))))
    by_word = a.join(b, [*keys, "w"]).filter((F.col("a") < F.col("b")) & sizes & one & (earlier + F.least(rest("a"), rest("b")) >= enough))

    pairs = F.flatten(F.transform("warm", lambda x, i: F.transform(F.slice("warm", i + 2, F.size("warm")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    a, b = sides(sets.filter(F.size("warm") > 1).select("*", F.explode(pairs).alias("w")), ["w"], ["cold", "warm"])
    both = F.array_intersect("warm_a", "warm_b")
    two = (F.size(F.array_intersect("cold_a", "cold_b")) == 0) & (F.get(both, F.lit(0)) == F.col("w.x")) & (F.get(both, F.lit(1)) == F.col("w.y"))
    by_two = a.join(b, [*keys, "w"]).filter((F.col("a") < F.col("b")) & sizes & two)

    small = sets.filter((F.size("warm") > 0) & (F.col("n") <= F.lit(1 / threshold + 1e-9))).select("*", F.explode("warm").alias("w"))
    a, b = sides(small, ["w"], [])
    single = a.filter("na = 1").join(b.filter("nb > 1"), [*keys, "w"]).filter(sizes)
    swap = F.col("a") > F.col("b")
    by_single = single.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("wb")).otherwise(F.col("wa")).alias("wa"),
                              F.when(swap, F.col("wa")).otherwise(F.col("wb")).alias("wb"))
    out = [*keys, "a", "b", "wa", "wb"]
    return by_word.select(*out).unionByName(by_two.select(*out)).unionByName(by_single)


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (``id``, ``comp``), ``comp`` the smallest id reached.

    Alternating large-star / small-star contraction until nothing changes: the
    number of rounds grows with the logarithm of the component size, not with its
    diameter, and the edge table shrinks to one edge per vertex.  Every round is
    checkpointed.
    """
    current = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, settled = None, False
    while not settled:
        current = _star(_star(current, keep_larger=True), keep_larger=False)
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state, settled = now, now == state
    label = current.select(F.col("u").alias("id"), F.col("v").alias("_m"))
    return (vertices.select("id").join(label, "id", "left")
            .select("id", F.coalesce("_m", "id").alias("comp")))


def _star(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """One contraction step; the result is a set of (larger, smaller) edges.

    The smallest neighbour is found by an aggregate, written and joined back:
    a vertex with a huge neighbourhood is never collected into one row, and
    Spark can split its edges in the join.
    """
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if keep_larger else edges
    low = cut_lineage(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    met = near.join(low, "u")
    if keep_larger:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return cut_lineage(out.filter("u <> v").distinct())


def set_key(words):
    """Canonical text of a word set, for collapsing copies."""
    return F.array_join(F.array_sort(words), "\u0001")
