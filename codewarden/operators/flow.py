"""Source-to-sink paths through imports and message channels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text
from ..functions.fixed import (BAA_COVERED, BAA_NONE, BUILTIN_SAFE, EXTERNAL_SINKS, SINK_ORDER, SOURCE_ORDER)
from ..functions.jsregex import glob
from ..session import cut_lineage
from .ordered import first_k, row_positions, running_sum
from .runtime import DYNAMIC

# Default depth of a path and paths kept per repository.
MAX_DEPTH = 5
MAX_PATHS = 20
LEVELS = ["low", "medium", "high"]

_HOP = "array<struct<file:string,name:string,line:int,mechanism:string>>"
_PICKS = "array<struct<k:int,a:bigint,b:bigint>>"
#: Tasks that the sources of one channel are dealt to.
SPREAD = 16


@dataclass
class FlowGraph:
    """Normalised inputs.  ``ord`` columns give the order of discovery.

    sources / sinks: repo, file, name, line, kind, ord
    edges:           repo, src, dst, symbols, external, ord
    transforms:      repo, file, name, input
    flows:           repo, path, kind, channel, function_name, line, ord
    """

    sources: DataFrame
    sinks: DataFrame
    edges: DataFrame
    transforms: DataFrame
    flows: DataFrame


def transform_edges(edges: DataFrame, transforms: DataFrame) -> DataFrame:
    """Add ``transforms``: a symbol is a transform of the importing file."""
    names = transforms.select("repo", F.col("file").alias("src"), F.explode(F.array("name", "input")).alias("_s")).distinct()
    hit = (edges.select("repo", "src", "ord", F.explode("symbols").alias("_s"))
           .join(names, ["repo", "src", "_s"], "left_semi")
           .select("repo", "src", "ord").distinct().withColumn("_t", F.lit(True)))
    return edges.join(hit, ["repo", "src", "ord"], "left").withColumn("transforms", F.coalesce("_t", F.lit(False))).drop("_t")


def _import_moves(g: FlowGraph) -> DataFrame:
    """(repo, node, next, pick, name, line, mechanism, transforms) per file pair.

    Parallel edges between two files differ only in order; the first one is the
    only one a shortest path can use, so pairs are reduced before the search.
    """
    e = transform_edges(g.edges.filter("not external"), g.transforms)
    name = F.coalesce(F.get("symbols", 0), F.lit("default"))
    hop = lambda mech: F.struct(name.alias("name"), F.lit(1).alias("line"), mech.alias("mechanism"))
    up = e.select("repo", F.col("dst").alias("node"), F.col("src").alias("next"),
                  F.struct(F.lit(1).alias("k"), F.col("ord").alias("a"), F.lit(0).cast("long").alias("b")).alias("pick"),
                  hop(F.when(F.col("transforms"), "transform").otherwise("import")).alias("hop"), "transforms")
    down = e.select("repo", F.col("src").alias("node"), F.col("dst").alias("next"),
                    F.struct(F.lit(2).alias("k"), F.col("ord").alias("a"), F.lit(0).cast("long").alias("b")).alias("pick"),
                    hop(F.lit("import-call")).alias("hop"), F.lit(False).alias("transforms"))
    both = up.unionByName(down).filter("node <> next")
    return both.groupBy("repo", "node", "next").agg(F.min_by(F.struct("pick", "hop", "transforms"), "pick").alias("m"))


def _channel_sides(g: FlowGraph) -> tuple[DataFrame, DataFrame]:
    """Senders and listeners, met through their channel: linear, not pairwise."""
    medium = F.when(F.col("kind").startswith("event"), F.lit("event")).otherwise(F.lit("queue"))
    d = g.flows.withColumn("medium", medium)
    send = d.filter(F.col("kind").isin("event-emit", "queue-publish")).groupBy(
        "repo", F.col("path").alias("node"), "medium", "channel").agg(
        F.min_by(F.struct("ord", "function_name", "line", "kind"), "ord").alias("s"))
    hear = d.filter(F.col("kind").isin("event-listen", "queue-subscribe")).groupBy(
        "repo", "medium", "channel", F.col("path").alias("next")).agg(F.min("ord").alias("l"))
    return send, hear


def _distance_to(goals: DataFrame, moves: DataFrame, send: DataFrame, hear: DataFrame, depth: int) -> DataFrame:
    """(repo, at, node, dist): steps to the nearest goal of each class ``at``, up to ``depth``; goals are (repo, at, node)."""
    frontier = cut_lineage(goals.select("repo", "at", "node").distinct().withColumn("dist", F.lit(0)))
    found = frontier  # the union of one written table per step
    for step in range(1, depth + 1):
        here = frontier.select("repo", "at", F.col("node").alias("next"))
        by_import = moves.select("repo", "node", "next").join(here, ["repo", "next"]).select("repo", "at", "node")
        open_channels = hear.join(here, ["repo", "next"]).select("repo", "at", "medium", "channel").distinct()
        by_channel = send.select("repo", "node", "medium", "channel").join(open_channels, ["repo", "medium", "channel"]).select("repo", "at", "node")
        frontier = cut_lineage(by_import.unionByName(by_channel).distinct()
                               .join(found, ["repo", "at", "node"], "left_anti").withColumn("dist", F.lit(step)))
        found = found.unionByName(frontier)
    return found


def _worthy(g: FlowGraph, dist: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Source files that can be among the first ``k`` paths (repo, origin), and the classes of sinks that can (repo, at).

    Paths rank by the class of their sink, then by length, then by source.  The
    best path of a source file to a class is as long as its distance.  So a file
    that is not among the first ``k`` for a class has ``k`` better paths to it, and
    a class is closed once better ones have ``k`` source files.  At most ``2k``
    files per repository are left, however many sources it has.
    """
    source_at = _position(F.col("kind"), SOURCE_ORDER)
    best = g.sources.groupBy("repo", F.col("file").alias("node")).agg(F.min(F.struct((-source_at).alias("at"), "ord")).alias("_c"))
    ways = best.join(dist, ["repo", "node"])
    better = Window.partitionBy("repo").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    per = ways.groupBy("repo", "at").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_n"))
    open_ = cut_lineage(per.withColumn("_before", F.coalesce(F.sum("_n").over(better), F.lit(0))).filter(F.col("_before") < k).select("repo", "at"))
    first = first_k(ways.join(open_, ["repo", "at"]), ["repo", "at"], [F.col("dist"), F.col("_c")], k)
    return first.select("repo", F.col("node").alias("origin")).distinct(), open_


def _search(start: DataFrame, moves: DataFrame, send: DataFrame, hear: DataFrame | None, first: int, depth: int) -> DataFrame:
    """States of a breadth-first search from ``start``, whose states are ``first`` hops long: the best one per (origin, node).

    ``moves`` and ``hear`` have the distance ``left`` from their ``next`` to a goal, so a
    step that cannot end in time is never made.  Without ``hear``, only imports are followed.
    """
    frontier = cut_lineage(start)
    found = frontier
    state = F.struct("hops", "picks", "transforms", "dynamic")
    for step in range(first + 1, depth + 1):
        if frontier.isEmpty():
            break
        in_time = F.col("left") <= depth - step
        steps = frontier.join(moves.filter(in_time), ["repo", "node"]).select(
            "repo", "origin", F.col("next").alias("node"),
            F.array_append("hops", F.struct(F.col("node").alias("file"), F.col("m.hop.name").alias("name"), F.col("m.hop.line").alias("line"),
                                            F.col("m.hop.mechanism").alias("mechanism"))).alias("hops"),
            F.array_append("picks", F.col("m.pick")).alias("picks"),
            (F.col("transforms") | F.col("m.transforms")).alias("transforms"), "dynamic")
        if hear is not None:
            heard = hear.filter(in_time).withColumns({"_hops": F.array().cast(_HOP), "_picks": F.array(_heard(F.col("l"))), "_t": F.lit(False), "_d": F.lit(False)})
            steps = steps.unionByName(_entries(frontier, send).join(heard, ["repo", "medium", "channel"]).select(
                "repo", "origin", F.col("next").alias("node"), *_through()))
        frontier = cut_lineage(
            steps.join(found.select("repo", "origin", "node"), ["repo", "origin", "node"], "left_anti")
            .groupBy("repo", "origin", "node").agg(F.min_by(state, "picks").alias("s")).select("repo", "origin", "node", "s.*"))
        found = found.unionByName(frontier)
    return found


def _heard(listener: Column) -> Column:
    """Pick of a channel hop as its channel knows it; the sender's order is put in by `_through`."""
    return F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("a"), listener.alias("b"))


def _entries(states: DataFrame, send: DataFrame) -> DataFrame:
    """One best state ``x`` per (origin, channel) before listeners multiply it."""
    return states.join(send, ["repo", "node"]).groupBy("repo", "origin", "medium", "channel").agg(
        F.min_by(F.struct("node", "hops", "picks", "transforms", "dynamic", "s"), F.struct(F.size("picks"), "picks", "s.ord")).alias("x"))


def _through() -> list[Column]:
    """State of an entry ``x``, the hop through its channel, and the rest of the path (_hops, _picks, _t, _d)."""
    hop = F.struct(F.col("x.node").alias("file"), F.col("x.s.function_name").alias("name"),
                   F.col("x.s.line").cast("int").alias("line"), F.col("x.s.kind").alias("mechanism"))
    pick = F.struct(F.lit(0).alias("k"), F.col("x.s.ord").alias("a"), F.get("_picks", 0)["b"].alias("b"))
    return [F.concat("x.hops", F.array(hop), "_hops").alias("hops"),
            F.concat("x.picks", F.array(pick), F.slice("_picks", 2, F.greatest(F.size("_picks") - 1, F.lit(0)))).alias("picks"),
            (F.col("x.transforms") | F.col("_t")).alias("transforms"),
            (F.col("x.dynamic") | F.col("_d") | F.col("channel").isin(DYNAMIC)).alias("dynamic")]


def reach(g: FlowGraph, depth: int = MAX_DEPTH, k: int | None = None) -> DataFrame:
    """Best path from every source file to every file with a sink that it reaches in ``depth`` hops.

    Only the shortest path to a sink is ever kept, and among equals the first
    one a depth-first walk would find.  Part of such a path is itself the best
    path between its ends, so a breadth-first search that keeps one state per
    (source file, file) finds the same paths without listing all simple paths.
    States that cannot reach a sink in the hops that are left are dropped.  With
    ``k``, so are source files and sinks that the first ``k`` paths of a
    repository cannot have, see `_worthy`.

    A channel has many listeners, and every source that gets to it goes on alike.
    So sources search along imports only, channels search once for all of them, and
    a path is a way to its first channel and the channel's way to the sink: pairs
    of a source and a file exist where the file has a sink, not on the way there.
    """
    moves = cut_lineage(_import_moves(g))
    send, hear = (cut_lineage(x) for x in _channel_sides(g))
    goals = g.sinks.select("repo", (_position(F.col("kind"), SINK_ORDER) if k is not None else F.lit(0)).alias("at"), F.col("file").alias("node"))
    dist = _distance_to(goals, moves, send, hear, depth)
    start = g.sources.select("repo", F.col("file").alias("origin"), F.col("file").alias("node")).distinct()
    if k is not None:
        origins, open_ = _worthy(g, dist, k)
        start = start.join(origins, ["repo", "origin"], "left_semi")
        dist = cut_lineage(dist.join(open_, ["repo", "at"]).groupBy("repo", "node").agg(F.min("dist").alias("dist")))
    left = dist.select("repo", F.col("node").alias("next"), F.col("dist").alias("left"))
    moves, hear = (cut_lineage(x.join(left, ["repo", "next"])) for x in (moves, hear))
    ends = dist.filter("dist = 0").select("repo", "node")
    none = [F.array().cast(_HOP).alias("hops"), F.array().cast(_PICKS).alias("picks"), F.lit(False).alias("transforms"), F.lit(False).alias("dynamic")]
    near = start.join(dist.select("repo", "node"), ["repo", "node"], "left_semi")
    own = _search(near.select("repo", "origin", "node", *none), moves, send, None, 0, depth)
    entries = cut_lineage(_entries(own, send))
    met = entries.select("repo", "medium", "channel").distinct()
    heard = hear.filter(F.col("left") <= depth - 1).join(met, ["repo", "medium", "channel"], "left_semi").select(
        "repo", F.struct("medium", "channel").alias("origin"), F.col("next").alias("node"), none[0], F.array(_heard(F.col("l"))).alias("picks"), *none[2:])
    rest = _search(heard, moves, send, hear, 1, depth).join(ends, ["repo", "node"], "left_semi").select(
        "repo", "origin.*", "node", F.col("hops").alias("_hops"), F.col("picks").alias("_picks"), F.col("transforms").alias("_t"), F.col("dynamic").alias("_d"))
    # A channel may be met by all sources: they are dealt to tasks, its ends are few next to the pairs.
    dealt = entries.withColumn("_part", F.pmod(F.xxhash64("origin"), F.lit(SPREAD)))
    copies = rest.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    by_channel = (dealt.join(copies, ["repo", "medium", "channel", "_part"]).filter(F.size("x.picks") + F.size("_picks") <= depth)
                  .select("repo", "origin", "node", *_through()))
    state = F.struct("hops", "picks", "transforms", "dynamic")
    return (own.join(ends, ["repo", "node"], "left_semi").unionByName(by_channel).groupBy("repo", "origin", "node")
            .agg(F.min_by(state, F.struct(F.size("picks"), "picks")).alias("s")).select("repo", "origin", "node", "s.*"))


def confidence(hops: Column, transforms: Column, dynamic: Column) -> Column:
    return (F.when(dynamic | (hops > 4), "low").when(transforms | (hops >= 3), "medium").otherwise("high"))


def base_severity(conf: Column, sink: Column, source: Column, sink_name: Column, safe: list[tuple[str, str]]) -> Column:
    sure = [p for p, kind in safe if kind in ("expected-sink", "compliant-sink")]
    expected = _matches(sink_name, sure)
    return (F.when((conf == "low") & expected, "INFO")
            .when((conf == "high") & (sink == "external-api"), "CRITICAL").when(conf == "high", "HIGH")
            .when((conf == "medium") & source.isin("fhir-bulk", "hl7-v2"), "HIGH").when(conf == "medium", "MEDIUM")
            .otherwise("LOW"))


def _matches(name: Column, globs: list[str]) -> Column:
    if not globs:
        return F.lit(False)
    return name.rlike("(?i)" + "|".join(f"(?:{glob(g)})" for g in globs))


def _position(col: Column, order: list[str]) -> Column:
    return sev.lookup(col, {k: i for i, k in enumerate(order)}, -1)


def flow_paths(g: FlowGraph, depth: int = MAX_DEPTH, k: int | None = MAX_PATHS, safe: list[tuple[str, str]] | None = None) -> DataFrame:
    """Shortest path per (source, sink), ranked, the first ``k`` per repository or all.

    Every state (source file, sink file) has a best pair of a source and a sink.
    A pair among the first ``k`` belongs to a state that is among the first ``k``
    by best pairs, so states are cut before their sources and sinks are paired.
    """
    safe = safe or []
    once = lambda df: df.groupBy("repo", "file", "name").agg(F.min_by(F.struct("line", "kind", "ord"), "ord").alias("x"))
    src = once(g.sources).select("repo", F.col("file").alias("origin"), F.struct("file", "name", "x.line", "x.kind", "x.ord").alias("source"))
    snk = once(g.sinks).select("repo", F.col("file").alias("node"), F.struct("file", "name", "x.line", "x.kind", "x.ord").alias("sink"))
    sink_at, source_at = _position(F.col("sink.kind"), SINK_ORDER), _position(F.col("source.kind"), SOURCE_ORDER)
    best_sink = snk.groupBy("repo", "node").agg(F.min(F.struct((-sink_at).alias("at"), F.col("sink.ord").alias("ord"))).alias("_k"))
    best_source = src.groupBy("repo", "origin").agg(F.min(F.struct((-source_at).alias("at"), F.col("source.ord").alias("ord"))).alias("_c"))
    states = reach(g, depth, k).withColumn("n_hops", F.size("hops")).join(best_source, ["repo", "origin"]).join(best_sink, ["repo", "node"])
    if k is not None:
        best = [F.col("_k.at"), F.col("n_hops"), F.col("_c.at"), F.col("_c.ord"), F.col("picks"), F.col("_k.ord")]
        states = first_k(states, ["repo"], best, k, "_r").drop("_r")
    # Places are in the ends; the picks, as plain numbers, only serve the order.
    plain = F.flatten(F.transform("picks", lambda p: F.array(p["k"].cast("long"), p["a"], p["b"])))
    d = states.drop("_k", "_c").join(src, ["repo", "origin"]).join(snk, ["repo", "node"]).drop("origin", "node").withColumn("picks", plain)
    order = [F.desc(sink_at), F.col("n_hops"), F.desc(source_at), F.col("source.ord"), F.col("picks"), F.col("sink.ord")]
    top = row_positions(d, ["repo"], order, "rank", without=["picks"]) if k is None else first_k(d, ["repo"], order, k, "rank")
    conf = confidence(F.col("n_hops"), F.col("transforms"), F.col("dynamic"))
    return top.withColumn("confidence", conf).withColumn("severity", base_severity(
        F.col("confidence"), F.col("sink.kind"), F.col("source.kind"), F.col("sink.name"), safe)).select(
        "repo", "rank", "source", "hops", "sink", "n_hops", "transforms", "dynamic", "confidence", "severity")


def apply_safe_patterns(paths: DataFrame, safe: list[tuple[str, str]] | None = None) -> DataFrame:
    """Sanitizers and projections on the way lower confidence; safe sinks are INFO."""
    table = [*BUILTIN_SAFE, *(safe or [])]
    of = lambda *kinds: [p for p, kind in table if kind in kinds]
    count = lambda globs: F.size(F.filter("hops", lambda h: _matches(h["name"], globs)))
    steps = count(of("sanitizer")) + count(of("projection"))
    level = F.greatest(_position(F.col("confidence"), LEVELS) - steps, F.lit(0))
    return paths.withColumn("confidence", sev.lookup(level, dict(enumerate(LEVELS)))).withColumn(
        "severity", F.when(_matches(F.col("sink.name"), of("expected-sink", "compliant-sink")), "INFO").otherwise(F.col("severity")))


# -- agreement registry ----------------------------------------------------------------

def registry(user: DataFrame | None, spark) -> DataFrame:
    """(pattern, status) of all services; ``user`` has (pattern, status).

    User entries win over defaults, and no-baa wins inside the user entries.
    """
    default = spark.createDataFrame(
        [(p, "covered") for p in BAA_COVERED] + [(p, "no-baa") for p in BAA_NONE], "pattern string, status string")
    if user is None:
        table = default
    else:
        own = user.select(F.lower("pattern").alias("pattern"), "status").distinct()
        no = own.filter("status = 'no-baa'")
        yes = own.filter("status = 'covered'").join(no.select("pattern"), "pattern", "left_anti")
        own = no.unionByName(yes)
        table = default.join(own.select("pattern"), "pattern", "left_anti").unionByName(own)
    return table.select(text.clean_domain(F.col("pattern")).alias("pattern"), "status").filter("pattern <> ''").distinct()


def classify_endpoints(urls: DataFrame, table: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``baa``; every suffix of a host meets the registry by equality.

    Distinct hosts are classified once; wildcard entries match their apex too.
    """
    d = urls.withColumn("host", text.hostname(F.col(url)))
    hosts = d.filter("host is not null").select("host").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asks = hosts.select("host", F.explode(F.array_append(F.transform(tails, lambda t: F.concat(F.lit("*."), t)), F.col("host"))).alias("pattern"))
    known = asks.join(table, "pattern").groupBy("host").agg(F.max(F.col("status") == "no-baa").alias("_no"))
    return (d.join(known, "host", "left").withColumn(
        "baa", F.when(F.col("_no").isNull(), "unknown").when(F.col("_no"), "no-baa").otherwise("covered")).drop("_no"))


# -- verdicts and findings ---------------------------------------------------------------

def apply_verdicts(paths: DataFrame) -> DataFrame:
    """Combine a path with its verdict columns and keep the leaks.

    Needs is_leak, verdict_confidence, explanation, baa_relevant and baa
    (status of an external sink, else null).
    """
    level = F.greatest(_position(F.col("confidence"), LEVELS), _position(F.col("verdict_confidence"), LEVELS))
    sure = F.when((F.col("verdict_confidence") == "high") & (F.col("severity") == "MEDIUM"), "HIGH").otherwise(F.col("severity"))
    raised = F.when((F.col("baa") == "no-baa") & F.col("sink.kind").isin(EXTERNAL_SINKS), sev.escalate(sure)).otherwise(sure)
    return paths.filter("is_leak").withColumns({
        "confidence": sev.lookup(level, dict(enumerate(LEVELS))), "severity": raised})


def path_findings(paths: DataFrame) -> DataFrame:
    """Verified paths as findings; ids count per repository in rank order."""
    at = lambda e: F.concat(F.col(f"{e}.file"), F.lit(":"), F.col(f"{e}.line").cast("string"))
    what = lambda e: F.concat(F.col(f"{e}.kind"), F.lit(" ("), F.col(f"{e}.name"), F.lit(")"))
    steps = F.transform("hops", lambda h: F.concat(h["file"], F.lit(":"), h["line"].cast("string"), F.lit(" ("), h["mechanism"], F.lit(")")))
    chain = F.array_join(F.concat(F.array(at("source")), steps, F.array(at("sink"))), " → ")
    kind, sink = F.col("sink.kind"), at("sink")
    # What the agreement status means in a finding.
    note = F.when(F.col("baa_relevant"), F.concat(
        F.lit("\n\nBAA Status: "), F.coalesce("baa", F.lit("unknown")), F.lit(" — "),
        F.when(F.col("baa") == "no-baa", "⚠️ External sink has NO Business Associate Agreement")
        .when(F.col("baa") == "covered", "✅ Covered by BAA").otherwise("❓ BAA status unknown — verify with compliance team"))).otherwise("")
    advice = (F.when(kind.isin("log", "error-tracking", "apm"), F.concat(F.lit("Redact PHI before it is logged at "), sink))
              .when(kind.isin("external-api", "webhook") & (F.col("baa") == "no-baa"),
                    F.concat(F.lit("No BAA covers the service called at "), sink, F.lit("; obtain one or strip PHI")))
              .when(kind.isin("external-api", "webhook"), F.concat(F.lit("Verify the BAA of the service called at "), sink))
              .when(kind == "analytics", F.concat(F.lit("Send only anonymous data to analytics at "), sink))
              .when(kind.isin("cache", "search-index"), F.concat(F.lit("Check access control and encryption of the "), kind, F.lit(" at "), sink))
              .otherwise(F.concat(F.lit("Review PHI handling at "), sink)))
    return running_sum(paths, ["repo"], ["rank"], F.lit(1), "_n").select(
        "repo", F.concat(F.lit("phi-flow-"), F.col("_n").cast("string")).alias("id"), "severity", F.lit("HIPAA / PHI Data Flow").alias("category"),
        F.concat(at("source"), F.lit(" → "), sink).alias("location"),
        F.concat(F.lit("PHI from "), what("source"), F.lit(" flows to "), what("sink")).alias("summary"),
        F.concat(F.lit("Flow chain: "), chain, F.lit("\nConfidence: "), "confidence", F.lit("\n"), F.coalesce("explanation", F.lit("")), note).alias("detail"),
        advice.alias("suggestion"), F.array(F.lit("hipaa")).alias("lenses"),
        F.when(F.col("confidence") == "high", 0.9).when(F.col("confidence") == "medium", 0.7).otherwise(0.5).alias("score"),
        F.lit("phi-flow-analysis").alias("scanner_id"), F.lit("HIPAA §164.502(a)").alias("regulation"))


def graph_stats(files: DataFrame, edges: DataFrame, paths: DataFrame, leaks: DataFrame) -> DataFrame:
    """Counts per repository; ``files`` has (repo, path, content)."""
    from .classify import language

    script = language(F.col("path")).isin("ts", "js")
    base = files.groupBy("repo").agg(
        F.count_if(script & F.col("content").isNotNull()).alias("files_analyzed"),
        F.count_if(script & F.col("content").isNull()).alias("files_failed"), F.count_if(~script).alias("files_skipped"))
    n = lambda df, name: df.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    out = base.join(n(edges, "total_edges"), "repo", "left").join(n(paths, "candidate_paths"), "repo", "left").join(n(leaks, "verified_leaks"), "repo", "left")
    return out.fillna(0)


def diagnostics(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, ord, level, message) for files and imports that could not be used:
    the count of skipped files, then files, then imports, each in path order."""
    from .classify import language

    script = language(F.col("path")).isin("ts", "js")
    at = lambda stage, path, n: F.struct(F.lit(stage).alias("stage"), path.alias("path"), n.cast("long").alias("n")).alias("ord")
    skipped = files.filter(~script).groupBy("repo").agg(F.count(F.lit(1)).alias("n")).select(
        "repo", at(0, F.lit(""), F.lit(0)), F.lit("info").alias("level"), F.concat(F.lit("Skipped "), F.col("n").cast("string"), F.lit(" non-TS/JS files for import graph")).alias("message"))
    missing = files.filter(script & F.col("content").isNull()).select(
        "repo", at(1, F.col("path"), F.lit(0)), F.lit("warn").alias("level"), F.concat("path", F.lit(": File not found or empty")).alias("message"))
    lost = edges.filter("not resolved").select("repo", at(2, F.col("src"), F.col("ord")), F.lit("warn").alias("level"), F.concat(
        F.lit("Could not resolve import '"), "dst", F.lit("' from "), "src").alias("message"))
    return skipped.unionByName(missing).unionByName(lost)


def merge_runtime(profiles: DataFrame, flows: DataFrame) -> DataFrame:
    """Profiled files plus files that only have runtime calls (empty profile)."""
    n = flows.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("runtime_flows"))
    return profiles.join(n, ["repo", "path"], "full").fillna(0)


def merge_calls(profiles: DataFrame, flows: DataFrame) -> DataFrame:
    """(repo, path, profile): runtime calls are appended to their file's profile;
    a file that has calls only gets a profile that is empty otherwise."""
    call = F.struct(F.col("kind").alias("type"), "channel", F.col("function_name").alias("functionName"), F.col("line").cast("double").alias("line"),
                    F.lit(None).cast("string").alias("dataParam"))
    order = F.struct("kind", "line", "channel", "function_name")
    calls = flows.groupBy("repo", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), call.alias("c")))), lambda x: x["c"]).alias("_calls"))
    kinds = {f.name: f.dataType.simpleString() for f in profiles.schema["profile"].dataType}
    every = lambda name: F.coalesce(F.col(f"profile.{name}"), F.array().cast(kinds[name])).alias(name)
    joined = F.concat(F.coalesce("profile.runtimeFlows", F.array().cast(kinds["runtimeFlows"])), F.coalesce("_calls", F.array().cast(kinds["runtimeFlows"])))
    whole = F.struct(*[every(name) for name in kinds if name != "runtimeFlows"], joined.alias("runtimeFlows"))
    return profiles.join(calls, ["repo", "path"], "full").select("repo", "path", whole.alias("profile"))


def field_table(spark, extra: DataFrame | None, defaults: list[str]) -> DataFrame:
    """(field, ord): defaults first, then configured ones, each once."""
    base = spark.createDataFrame([(f, i) for i, f in enumerate(defaults)], "field string, ord long")
    both = base if extra is None else base.unionByName(extra.select("field", (F.col("ord") + len(defaults)).alias("ord")))
    return both.groupBy("field").agg(F.min("ord").alias("ord"))
