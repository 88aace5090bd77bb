"""Session analytics: matching, statistics, digests and process findings."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.jsregex import js
from ..session import shuffled, written
from ..sources.traces import cut, only_string, parse_lines
from .ordered import first_k, neighbour, running_sum

# Digest limits and rendering widths.
COLLAPSE_OVER_TOKENS = 60_000
CAP_TOKENS = 200_000
TOKENS_PER_CHAR = 0.4
COMMAND_CHARS = 120
RUN_MIN = 6
ORPHAN = "<orphan_tool_result>"
ADDRESSED = js(r"\b(fix|error|issue|problem|correct|handle|catch)\b", "i")


class Trace:
    """A transcript as tables: ``lines``, ``events`` (session, idx, ...) and
    ``calls`` (session, idx, call_no, ...).

    Each is written once, when it is first asked for, and every later reader
    shares it: statistics of lines never bind results, and those of events
    never compute what makes calls similar.
    """

    def __init__(self, raw: DataFrame):
        self.lines = written(parse_lines(raw), "lines")

    @cached_property
    def plain_calls(self) -> DataFrame:
        """(session, pos, call_no, id, name, input) as the lines have them."""
        return self.lines.filter("kind = 'assistant'").select(
            "session", "pos", F.posexplode("calls").alias("call_no", "c")).select(
            "session", "pos", "call_no", "c.id", "c.name", "c.input")

    @cached_property
    def _bound(self) -> tuple[DataFrame, DataFrame]:
        results = self.lines.filter("kind = 'user'").select(
            "session", "pos", "ts", "uuid", F.posexplode("results").alias("call_no", "r")).select(
            "session", "pos", "ts", "uuid", "call_no", "r.*")
        return match_results(self.plain_calls, results)

    @staticmethod
    def _sub(last: bool, n: Column) -> Column:
        """Order within a line: a user event follows the orphan results."""
        return F.struct(F.lit(last).alias("last"), n.cast("int").alias("n")).alias("sub")

    @cached_property
    def events(self) -> DataFrame:
        user = self.lines.filter("kind = 'user' and (text is not null or size(results) = 0)")
        main = self.lines.filter("kind in ('assistant', 'system')").unionByName(user).select(
            "session", "pos", self._sub(True, F.lit(0)), F.col("kind").alias("type"), "ts", "uuid", "text", "thinking")
        lost = self._bound[1].select(
            "session", "pos", self._sub(False, F.col("call_no")), F.lit("tool_use").alias("type"), "ts",
            "uuid", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("thinking"))
        numbered = running_sum(main.unionByName(lost), ["session"], ["pos", "sub"], F.lit(1), "_n")
        return written(numbered.withColumn("idx", F.col("_n") - 1).drop("_n"), "events")

    @cached_property
    def calls(self) -> DataFrame:
        matched, orphans = self._bound
        own = matched.withColumn("sub", self._sub(True, F.lit(0))).unionByName(orphans.select(
            "session", "pos", self._sub(False, F.col("call_no")), F.lit(0).alias("call_no"), "id", F.lit(ORPHAN).alias("name"),
            F.lit("{}").alias("input"), F.col("content").alias("result"), "is_error"))
        placed = own.join(shuffled(self.events.select("session", "pos", "sub", "idx")), ["session", "pos", "sub"]).drop("sub")
        return written(with_keys(placed), "calls")


def build(raw: DataFrame) -> Trace:
    """Raw (session, pos, line) rows to events and calls with their results."""
    return Trace(raw)


def match_results(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bind results to calls by id.

    In the order of one id, a result belongs to the item right before it when
    that is a call: a re-used id is open for its latest call only, and a call
    is closed by its first result.
    """
    payload = [c for c in results.columns if c not in ("session", "pos", "call_no", "id")]
    given = results.select("session", "pos", "call_no", "id", F.struct(*payload).alias("_r"), F.lit(False).alias("is_call"))
    items = calls.select("session", "pos", "call_no", "id", F.lit(None).cast(given.schema["_r"].dataType).alias("_r"), F.lit(True).alias("is_call")).unionByName(given)
    seen = neighbour(items.filter("id <> ''"), ["session", "id"], ["pos", "call_no"], F.struct("is_call", "pos", "call_no"), "prev").filter("not is_call")
    open_call = F.when(F.col("prev.is_call"), F.col("prev"))
    bound = seen.withColumns({"call_pos": open_call["pos"], "call_at": open_call["call_no"]}).drop("prev")
    alone = given.filter("coalesce(id, '') = ''").withColumns({"call_pos": F.lit(None).cast("long"), "call_at": F.lit(None).cast("int")})
    # Results travel with their place and are read by both outputs: written once.
    known = written(bound.unionByName(alone).select("session", "pos", "call_no", "id", "_r.*", "call_pos", "call_at"), "results")
    orphans = known.filter("call_pos is null").drop("call_pos", "call_at")
    answers = known.filter("call_pos is not null").select(
        "session", F.col("call_pos").alias("pos"), F.col("call_at").alias("call_no"),
        F.col("content").alias("result"), "is_error")
    return calls.join(shuffled(answers), ["session", "pos", "call_no"], "left"), orphans


def with_keys(calls: DataFrame) -> DataFrame:
    """Add ``file_path``, ``command`` and the similarity key.

    Two calls are similar when their keys are equal: same tool and, for Bash,
    the same command; else the same file path when both have one; else equal
    input.  A call with a path is never similar to one without, so one key
    column expresses the relation.
    """
    command = F.coalesce(_string("command"), F.lit(""))
    path = F.coalesce(_string("file_path"), F.lit(""))
    body = F.when(F.col("name") == "Bash", F.concat(F.lit("c:"), command)).when(
        path != "", F.concat(F.lit("p:"), path)).otherwise(F.concat(F.lit("i:"), F.coalesce("input", F.lit("{}"))))
    return _with_fields(calls, ["file_path", "command"]).withColumns({
        "file_path": _string("file_path"), "command": _string("command"), "key": F.concat_ws("\u0001", "name", body)}).drop("_fields")


def _with_fields(calls: DataFrame, fields: list[str]) -> DataFrame:
    """Add ``_fields``, these fields of the input as text; the input is read once for all of them."""
    return calls.withColumn("_fields", F.from_json("input", ", ".join(f"`{f}` string" for f in fields)))


def _string(field: str) -> Column:
    """A field of the input only when it is a JSON string."""
    return only_string(F.col(f"_fields.{field}"), F.try_parse_json("input"), field)


# -- statistics --------------------------------------------------------------------

def session_stats(trace: Trace) -> DataFrame:
    """One row per session; first and last follow file order, not time."""
    seen = F.col("kind").isin("user", "assistant", "system", "unknown")
    some = lambda c: F.when(seen & (F.coalesce(c, F.lit("")) != ""), F.col("pos"))
    per_line = trace.lines.groupBy("session").agg(
        F.min_by("session_id", some("session_id")).alias("session_id"),
        F.min_by("model", some("model")).alias("model"),
        F.min_by("ts", some("ts")).alias("started_at"), F.max_by("ts", some("ts")).alias("ended_at"),
        F.count_if(F.col("kind").isin("bad", "unknown")).alias("warnings"),
        F.coalesce(F.sum(F.when(F.col("kind") == "user", F.size(F.filter("results", lambda r: r["is_error"])))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("kind") == "assistant", F.size("calls"))), F.lit(0)).alias("tool_calls"))
    per_event = trace.events.groupBy("session").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("type") == "user").alias("prompts"))
    ms = lambda c: F.unix_millis(F.try_to_timestamp(c))
    return (per_line.join(shuffled(per_event), "session", "left").fillna(0, ["events", "prompts"])
            .withColumn("duration_ms", ms(F.col("ended_at")) - ms(F.col("started_at")))
            .withColumn("duration", text.duration(F.col("duration_ms"))))


def tool_distribution(trace: Trace) -> DataFrame:
    return (trace.plain_calls.groupBy("session", F.col("name").alias("tool"))
            .agg(F.count(F.lit(1)).alias("calls")))


# -- digest ------------------------------------------------------------------------

_FIELDS = ["content", "pattern", "query", "path", "description"]


def _render() -> Column:
    """One call as digest text; null for scratch notes."""
    low = F.lower("name")
    s = lambda f: F.coalesce(F.col(f), F.lit(""))
    status = F.when(F.col("is_error").isNull(), "").when(F.col("is_error"), " → ERR").otherwise(" → OK")
    size = F.call_function("format_number", F.length(s("content")) / 1024, F.lit("0.0"))
    return (F.when(low == "bash", F.concat(F.lit("Bash: "), cut(F.col("_command"), COMMAND_CHARS), status))
            .when(low.isin("write", "edit", "replace"),
                  F.concat("name", F.lit(" "), s("file_path"), F.lit(" ("), size, F.lit("KB)")))
            .when(low == "read", F.concat(F.lit("Read "), s("file_path")))
            .when(low.isin("grep", "glob"), F.concat(
                "name", F.lit(' "'), F.coalesce("pattern", "query", F.lit("")), F.lit('"'),
                F.when(s("path") != "", F.concat(F.lit(" in "), s("path"))).otherwise("")))
            .when(low == "task", F.concat(F.lit("Subagent: "), F.left(s("description"), F.lit(100))))
            .when(low != "todowrite", F.concat_ws(" ", "name", F.nullif(F.col("file_path"), F.lit("")))))


def rendered(trace: Trace) -> DataFrame:
    """(session, idx, line) of every event that shows in a digest.

    Calls are gathered per event, that is per transcript line.
    """
    fields = _with_fields(trace.calls.filter(F.col("name") != ORPHAN), _FIELDS).withColumns(
        {**{f: _string(f) for f in _FIELDS}, "_command": text.trim(F.coalesce("command", F.lit("")))})
    calls = (fields.withColumn("_r", _render())
             .groupBy("session", "idx").agg(F.array_sort(F.collect_list(F.struct("call_no", "_r"))).alias("_calls")))
    said = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("ASSISTANT: "), "text"))
    did = F.coalesce(F.col("_calls._r"), F.array().cast("array<string>"))
    line = (F.when((F.col("type") == "user") & (F.coalesce("text", F.lit("")) != ""), F.concat(F.lit("USER: "), "text"))
            .when(F.col("type") == "assistant", F.nullif(F.concat_ws(" | ", said, did), F.lit(""))))
    return (trace.events.filter("type in ('user', 'assistant')").join(shuffled(calls), ["session", "idx"], "left")
            .select("session", "idx", line.alias("line")).filter("line is not null"))


def drop_repeats(lines: DataFrame) -> DataFrame:
    """Remove a line equal to the one before it."""
    d = neighbour(lines, ["session"], ["idx"], F.col("line"), "_prev")
    return d.filter(~F.col("line").eqNullSafe(F.col("_prev"))).drop("_prev")


def _over(lines: DataFrame, tokens: int) -> DataFrame:
    """Sessions whose joined text is estimated above a token count."""
    size = lines.groupBy("session").agg((F.sum(F.length("line") + 1) - 1).alias("_chars"))
    return size.filter(F.col("_chars") * TOKENS_PER_CHAR > tokens).select("session")


def collapse_runs(lines: DataFrame, over: int = COLLAPSE_OVER_TOKENS, minimum: int = RUN_MIN) -> DataFrame:
    """Replace long runs of error-free tool lines by a count per tool."""
    big = _over(lines, over)
    rest = lines.join(big, "session", "left_anti")
    quiet = ~F.col("line").startswith("USER:") & ~F.col("line").startswith("ASSISTANT:") & ~F.col("line").contains("→ ERR")
    d = lines.join(big, "session", "left_semi").withColumn("_quiet", quiet)
    d = neighbour(d, ["session"], ["idx"], F.col("_quiet"), "_before")
    d = running_sum(d, ["session"], ["idx"],
                    F.when(F.col("_quiet") & F.coalesce("_before", F.lit(False)), 0).otherwise(1), "_run")
    d = written(d, "runs")
    tool = F.regexp_replace(F.split_part("line", F.lit(" "), F.lit(1)), "^([^:]*):", "$1")
    # Counts per (run, tool) first: a run of any length is a few rows after it.
    per_tool = (d.filter("_quiet").groupBy("session", "_run", tool.alias("_tool"))
                .agg(F.count(F.lit(1)).alias("_n"), F.min("idx").alias("_first")))
    label = lambda x: F.concat(x["n"].cast("string"), F.lit(" "), F.lower(x["t"]), F.when(x["n"] != 1, F.lit("s")).otherwise(F.lit("")))
    runs = (per_tool.groupBy("session", "_run").agg(
        F.sum("_n").alias("_total"), F.min("_first").alias("idx"),
        F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.col("_first").alias("f"), F.col("_n").alias("n"), F.col("_tool").alias("t")))).alias("_l"))
        .filter(F.col("_total") >= minimum)
        .select("session", "_run", "idx", F.concat(F.lit("[exploration: "), F.array_join(F.transform("_l", label), ", "), F.lit("]")).alias("line")))
    kept = d.join(shuffled(runs.select("session", "_run")), ["session", "_run"], "left_anti").select("session", "idx", "line")
    return rest.select("session", "idx", "line").unionByName(kept).unionByName(runs.select("session", "idx", "line"))


def cut_middle_lines(lines: DataFrame, cap: int = CAP_TOKENS) -> DataFrame:
    """Head and tail of very long digests; the middle becomes one marker line."""
    big = _over(lines, cap)
    rest = lines.join(big, "session", "left_anti")
    d = lines.join(big, "session", "left_semi").withColumn("_len", F.length("line") + 1)
    d = running_sum(d, ["session"], ["idx"], F.col("_len"), "_cum")
    ends = d.groupBy("session").agg(
        F.min("idx").alias("_a"), F.max("idx").alias("_z"), F.count(F.lit(1)).alias("_rows"), F.sum("_len").alias("_sum"),
        F.min_by("_len", "idx").alias("_la"), F.max_by("_len", "idx").alias("_lz"))
    half = F.lit(cap / TOKENS_PER_CHAR * 0.5)
    d = d.join(shuffled(ends), "session")
    head = (F.col("idx") == F.col("_a")) | ((F.col("idx") < F.col("_z")) & (F.col("_cum") <= F.greatest(half, F.col("_la"))))
    tail_cum = F.col("_sum") - F.col("_cum") + F.col("_len")
    tail = (F.col("idx") == F.col("_z")) | ((F.col("idx") > F.col("_a")) & (tail_cum <= F.greatest(half, F.col("_lz"))))
    d = d.withColumn("_keep", (F.col("_rows") <= 2) | head | tail)
    gone = (d.filter("not _keep").groupBy("session").agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("_n"))
            .select("session", "idx", F.concat(F.lit("[… elided "), F.col("_n").cast("string"), F.lit(" events …]")).alias("line")))
    return rest.select("session", "idx", "line").unionByName(d.filter("_keep").select("session", "idx", "line")).unionByName(gone)


def digest(trace: Trace) -> DataFrame:
    # Each step reads its input several times; materialise between the steps.
    lines = written(drop_repeats(written(rendered(trace), "rendered")), "digest")
    return cut_middle_lines(written(collapse_runs(lines), "collapsed"))


# -- process findings ----------------------------------------------------------------

def _finding(signal: str, level: str, description: Column, evidence: Column, index: Column, call: Column | None = None) -> list[Column]:
    return [F.col("session"), F.lit(signal).alias("signal"), F.lit(level).alias("severity"),
            description.alias("description"), evidence.alias("evidence"), index.cast("long").alias("event_index"), (F.lit(0) if call is None else call).cast("long").alias("call_no")]


def dead_ends(trace: Trace, chars: int = 80, shown_errors: int = 3) -> DataFrame:
    """Errors followed by a different attempt; one finding per session."""
    d = neighbour(trace.calls, ["session"], ["idx", "call_no"], F.when(F.col("call_no") == 0, F.struct("idx", "key")), "next", forward=True)
    bad = d.filter(F.col("is_error") & F.col("next").isNotNull() & (F.col("next.key") != F.col("key")))
    shown = F.concat("name", F.lit(": "), F.left("result", F.lit(chars)))
    top = first_k(bad.select("session", "idx", "call_no", shown.alias("e")), ["session"], [F.col("idx"), F.col("call_no")], shown_errors)
    evidence = top.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "e"))), lambda x: x["e"]), " → ").alias("evidence"))
    n = bad.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    words = F.concat(F.lit("Agent had "), F.col("n").cast("string"), F.lit(" dead end"), F.when(F.col("n") > 1, "s").otherwise(""),
                     F.lit(" before reaching final solution. High count suggests fragility."))
    return n.join(shuffled(evidence), "session").select(*_finding("dead_end", "warning", words, F.col("evidence"), F.lit(0)))


def retry_storms(trace: Trace, minimum: int = 3, chars: int = 60) -> DataFrame:
    """Runs of similar calls; the run is an aggregate, not a list."""
    d = neighbour(trace.calls, ["session"], ["idx", "call_no"], F.col("key"), "_prev")
    d = running_sum(d, ["session"], ["idx", "call_no"], F.when(F.col("key") == F.col("_prev"), 0).otherwise(1), "_run")
    runs = d.groupBy("session", "_run").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("idx", "call_no", "name", "command"), F.struct("idx", "call_no")).alias("c"))
    runs = runs.filter(F.col("n") >= minimum)
    what = F.when((F.col("c.name") == "Bash") & F.col("c.command").isNotNull(), F.left("c.command", F.lit(chars))).otherwise(F.col("c.name"))
    count = F.col("n").cast("string")
    return runs.select(*_finding(
        "retry_storm", "warning", F.concat(F.lit("Same command retried "), count, F.lit(" times — suggests flaky approach.")),
        F.concat("c.name", F.lit(": "), what, F.lit(" (repeated "), count, F.lit("x)")), F.col("c.idx"), F.col("c.call_no")))


def unhandled_errors(trace: Trace, chars: int = 100, within: int = 3) -> DataFrame:
    """Errors that none of the next events picks up, three by default.

    Each error asks for three event numbers; answers come by equi-joins on
    (session, event), so a long session is spread over its events.
    """
    bad = trace.calls.filter("is_error").select("session", "idx", "call_no", "name", "key", "file_path", "result")
    asks = bad.select("session", F.col("idx").alias("_i"), F.col("call_no").alias("_c"), F.col("key").alias("_key"), F.col("file_path").alias("_path"),
                      F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + within)).alias("idx"))
    said = asks.join(shuffled(trace.events.filter(F.col("text").rlike(ADDRESSED)).select("session", "idx")), ["session", "idx"], "left_semi")
    again = asks.join(shuffled(trace.calls.select("session", "idx", "key", "name", "file_path")), ["session", "idx"]).filter(
        (F.col("key") == F.col("_key")) | (F.col("name").isin("Write", "Edit") & (F.col("file_path") == F.col("_path"))))
    handled = said.select("session", "_i", "_c").unionByName(again.select("session", "_i", "_c")).distinct()
    left = bad.join(shuffled(handled.withColumnsRenamed({"_i": "idx", "_c": "call_no"})), ["session", "idx", "call_no"], "left_anti")
    return left.select(*_finding(
        "unhandled_error", "warning", F.lit("Agent encountered an error but continued without addressing it."),
        F.concat("name", F.lit(": "), F.left("result", F.lit(chars))), F.col("idx"), F.col("call_no")))


def low_exploration(trace: Trace) -> DataFrame:
    prompts = trace.events.groupBy("session").agg(F.count_if(F.col("type") == "user").alias("prompts"))
    calls = trace.calls.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("is_error", F.lit(False))).alias("bad"))
    d = prompts.join(shuffled(calls), "session").filter("prompts <= 1 and n > 5 and not bad")
    return d.select(*_finding(
        "low_exploration", "info", F.lit("Agent went with first approach without exploring alternatives."),
        F.concat(F.lit("Single prompt, "), F.col("n").cast("string"), F.lit(" tool calls, no errors — straightforward but potentially shallow.")),
        F.lit(0)))


# Detectors in reporting order.
DETECTORS = [dead_ends, retry_storms, unhandled_errors, low_exploration]


def process_findings(trace: Trace) -> DataFrame:
    """All signals; ``sort_key`` puts warnings before information, then goes by detector, event and call."""
    out = None
    for n, detect in enumerate(DETECTORS):
        d = detect(trace).withColumn("_d", F.lit(n))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("sort_key", F.struct(
        (F.col("severity") != "warning").alias("late"), F.col("_d").alias("detector"), "event_index", "call_no")).drop("_d")
