"""The data-flow analysis as one job: profile, link, search, verify, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import EXTERNAL_SINKS
from ..operators import classify, flow, imports, inference, packing, runtime
from ..operators.ordered import row_positions
from ..session import cut_lineage
from ..sources import responses

PROFILE_SYSTEM = (
    "List where a file reads protected health information, where such data leaves it, how it is transformed and what it exports. "
    "Answer with one JSON object with the arrays sources, sinks, transforms, exports, imports and runtimeFlows.")
VERIFY_SYSTEM = (
    "Decide whether protected health information really flows from the source to the sink unprotected. "
    "Answer with one JSON object with isLeak, confidence (high, medium or low), explanation and baaRelevant.")


@dataclass(frozen=True)
class FlowOptions:
    """Everything a caller may set; the defaults are the stock analysis."""

    depth: int = flow.MAX_DEPTH
    paths: int | None = flow.MAX_PATHS
    files: int = 200
    safe: tuple[tuple[str, str], ...] = ()
    radius: int = 8
    order: str = "path"
    profile_system: str = PROFILE_SYSTEM
    verify_system: str = VERIFY_SYSTEM


@dataclass
class FlowAnalysis:
    """``profiles`` of files with their runtime calls; ``refused`` holds answers that could not
    be read; ``candidates`` are ranked paths, ``leaks`` the verified ones, ``findings`` their reports."""

    profiles: DataFrame
    refused: DataFrame
    candidates: DataFrame
    leaks: DataFrame
    findings: DataFrame
    stats: DataFrame
    diagnostics: DataFrame


def ask(prompts: DataFrame, complete: Callable[[str, str], str], keys: list[str], read: Callable[[DataFrame, list[str]], DataFrame], value: str) -> DataFrame:
    """(keys, value, error) of every prompt; an answer that cannot be read is asked for once more, with the reason."""
    def once(rows: DataFrame) -> DataFrame:
        raw = cut_lineage(inference.infer(rows, complete, keys))
        read_ = read(raw.select(*keys, "raw"), keys).join(raw.select(*keys, F.col("error").alias("_failed")), keys)
        return cut_lineage(read_.select(*keys, value, F.coalesce("_failed", "error").alias("error"), F.col("_failed").isNotNull().alias("_failed")))

    first = once(prompts)
    bad = first.filter("error IS NOT NULL AND NOT _failed")
    if bad.isEmpty():
        return first.drop("_failed")
    why = F.concat("user", F.lit("\n\nThe last answer could not be used:\n"), "error", F.lit("\nAnswer again with valid JSON of the form asked for."))
    second = once(prompts.join(bad.select(*keys, "error"), keys).withColumn("user", why).select(*prompts.columns))
    return first.join(second.select(*keys), keys, "left_anti").unionByName(second).drop("_failed")


def profile_prompts(files: DataFrame, options: FlowOptions) -> DataFrame:
    """One prompt per file worth profiling: the first ``options.files`` of a repository."""
    worth = classify.profiling_order(files, options.files, options.order).select("repo", "path")
    user = F.concat(F.lit("File: "), "path", F.lit("\n\n"), "content")
    return files.join(worth, ["repo", "path"]).select("repo", "path", F.lit(options.profile_system).alias("system"), user.alias("user"))


def graph_of(profiles: DataFrame, edges: DataFrame) -> flow.FlowGraph:
    """The graph of profiled files; order is by path, then place in the profile."""
    def rows(field: str, *columns: Column) -> DataFrame:
        return profiles.select("repo", F.col("path").alias("file"), F.posexplode(f"profile.{field}").alias("_n", "x")).select("repo", "file", "_n", *columns)

    def numbered(df: DataFrame) -> DataFrame:
        return row_positions(df, ["repo"], [F.col("file"), F.col("_n")], "ord").drop("_n")

    end = (F.col("x.name").alias("name"), F.col("x.line").cast("int").alias("line"), F.col("x.type").alias("kind"))
    calls = numbered(rows("runtimeFlows", F.col("x.type").alias("kind"), F.col("x.channel").alias("channel"), F.col("x.functionName").alias("function_name"),
                          F.col("x.line").cast("int").alias("line"))).withColumnRenamed("file", "path")
    ordered = row_positions(edges.withColumnRenamed("ord", "_n"), ["repo"], [F.col("src"), F.col("_n")], "ord").drop("_n")
    return flow.FlowGraph(numbered(rows("sources", *end)), numbered(rows("sinks", *end)), ordered,
                          rows("transforms", F.col("x.name").alias("name"), F.col("x.inputParam").alias("input")).drop("_n"), calls)


def verify_prompts(paths: DataFrame, files: DataFrame, options: FlowOptions) -> DataFrame:
    """One prompt per candidate path with the code around both ends."""
    d = paths.select("repo", "rank", "source", "hops", "sink", "baa")
    for end in ("source", "sink"):
        at = d.withColumns({"path": F.col(f"{end}.file"), "line": F.col(f"{end}.line")})
        d = packing.snippets(at, files, options.radius).withColumnRenamed("snippet", f"_{end}").drop("path", "line")
    name = lambda end: F.concat(F.col(f"{end}.kind"), F.lit(" "), F.col(f"{end}.name"), F.lit(" ("), F.col(f"{end}.file"), F.lit(":"), F.col(f"{end}.line").cast("string"), F.lit(")"))
    steps = F.array_join(F.transform("hops", lambda h: F.concat(h["file"], F.lit(":"), h["line"].cast("string"), F.lit(" "), h["name"], F.lit(" ("), h["mechanism"], F.lit(")"))), "\n")
    user = F.concat(F.lit("Source: "), name("source"), F.lit("\n"), "_source", F.lit("\n\nSteps:\n"), steps, F.lit("\n\nSink: "), name("sink"), F.lit("\n"), "_sink",
                    F.lit("\n\nAgreement: "), F.coalesce("baa", F.lit("no external service")))
    return d.select("repo", "rank", F.lit(options.verify_system).alias("system"), user.alias("user"))


def analyse(files: DataFrame, complete: Callable[[str, str], str], options: FlowOptions = FlowOptions(), agreements: DataFrame | None = None) -> FlowAnalysis:
    """Find verified flows in (repo, path, content) files; ``agreements`` is (pattern, status), see `flow.registry`."""
    keys = ["repo", "path"]
    known = files.filter(F.coalesce(F.col("content"), F.lit("")) != "")
    answers = ask(profile_prompts(known, options), complete, keys, responses.ingest_profiles, "profile")
    calls = runtime.runtime_flows(known.select("repo", "path", "content"))
    profiles = cut_lineage(flow.merge_calls(answers.filter("profile IS NOT NULL").select("repo", "path", "profile"), calls))
    edges = cut_lineage(imports.import_edges(files.select("repo", "path", "content")))
    found = flow.flow_paths(graph_of(profiles, edges), options.depth, options.paths, list(options.safe))
    safe = flow.apply_safe_patterns(found, list(options.safe))
    rated = flow.classify_endpoints(safe.withColumn("_url", F.col("sink.name")), flow.registry(agreements, files.sparkSession), "_url").drop("_url", "host")
    candidates = cut_lineage(rated.withColumn("baa", F.when(F.col("sink.kind").isin(EXTERNAL_SINKS), F.col("baa"))))
    verdicts = ask(verify_prompts(candidates, known.select("repo", "path", "content"), options), complete, ["repo", "rank"], responses.ingest_path_verdicts, "verdict")
    told = verdicts.filter("verdict IS NOT NULL").select("repo", "rank", F.col("verdict.isLeak").alias("is_leak"), F.col("verdict.confidence").alias("verdict_confidence"),
                                                         F.col("verdict.explanation").alias("explanation"), F.col("verdict.baaRelevant").alias("baa_relevant"))
    leaks = cut_lineage(flow.apply_verdicts(candidates.join(told, ["repo", "rank"])))
    refused = answers.filter("error IS NOT NULL").select("repo", F.col("path").alias("what"), "error").unionByName(
        verdicts.filter("error IS NOT NULL").select("repo", F.concat(F.lit("path "), F.col("rank").cast("string")).alias("what"), "error"))
    # The note on files beyond the bound.
    many = files.filter("content IS NOT NULL").groupBy("repo").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > options.files).select(
        "repo", F.struct(F.lit(-1).alias("stage"), F.lit("").alias("path"), F.lit(0).cast("long").alias("n")).alias("ord"), F.lit("warn").alias("level"),
        F.concat(F.lit("Flow analysis: "), F.col("n").cast("string"), F.lit(f" files exceed max of {options.files}. Only the top {options.files} will be profiled.")).alias("message"))
    notes = many.unionByName(flow.diagnostics(files.select("repo", "path", "content"), edges))
    return FlowAnalysis(profiles, refused, candidates, leaks, flow.path_findings(leaks),
                        flow.graph_stats(files.select("repo", "path", "content"), edges, candidates, leaks), notes)
