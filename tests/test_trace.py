import contextlib
import io
import json
import re

from codewarden.operators import trace as tr
from codewarden.sources.traces import parse_lines, read_lines


def call(i, name, **args):
    return {"type": "assistant", "message": {"model": "m", "content": [{"type": "tool_use", "id": i, "name": name, "input": args}]}}


def result(i, text, bad=False):
    return {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": text, "is_error": bad}]}}


LINES = [
    {"type": "summary", "x": 1}, {"type": "user", "sessionId": "s", "timestamp": "2025-06-01T10:00:00Z", "message": {"content": "go"}},
    call("1", "Bash", command="npm test"), result("1", "E" * 500, True), call("1", "Bash", command="npm test"), result("1", "ok"),
    result("1", "again"), call("2", "Bash", command="npm test"), call("3", "Edit", file_path="a.ts"), result("3", "no", True),
    call("4", "Edit", file_path="b.ts"), {"type": "system", "timestamp": "2025-06-01T10:01:04Z"}, {"type": "new"}]


def build(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in LINES) + "\n\nnot json\n[1]\n")
    return tr.build(read_lines(spark, str(p)))


def test_results_bind_to_the_latest_open_call(spark, tmp_path):
    t = build(spark, tmp_path)
    got = [(r.name, r.result and len(r.result), r.is_error) for r in t.calls.orderBy("idx", "call_no").collect()]
    assert got == [("Bash", 401, True), ("Bash", 2, False), ("<orphan_tool_result>", 5, False), ("Bash", None, None), ("Edit", 2, True), ("Edit", None, None)]
    s = tr.session_stats(t).first()
    assert (s.events, s.prompts, s.tool_calls, s.errors, s.warnings, s.duration, s.session_id, s.model) == (8, 1, 5, 2, 3, "1m 4s", "s", "m")


def test_signals(spark, tmp_path):
    t = build(spark, tmp_path)
    got = sorted((r.signal, r.event_index) for r in tr.process_findings(t).collect())
    assert got == [("dead_end", 0), ("unhandled_error", 5)]


def test_digest_and_collapse(spark):
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(["USER: a", *["Read f"] * 3, *["Bash: x → OK"] * 4, "Bash: y → ERR", "Grep z"])], "session string, idx int, line string")
    got = [r.line for r in tr.collapse_runs(lines, over=1, minimum=3).orderBy("idx").collect()]
    assert got == ["USER: a", "[exploration: 4 bashs, 3 reads]", "Bash: y → ERR", "Grep z"]
    long = spark.createDataFrame([("s", i, "x" * 9) for i in range(50)], "session string, idx int, line string")
    cut = [r.line for r in tr.cut_middle_lines(long, cap=40).orderBy("idx").collect()]
    assert cut == ["x" * 9] * 5 + ["[… elided 40 events …]"] + ["x" * 9] * 5


def test_calls_of_one_event_keep_their_order(spark, tmp_path):
    """Two errors of one event, the later one first by name, are reported in the order of the calls."""
    both = {"type": "assistant", "message": {"model": "m", "content": [
        {"type": "tool_use", "id": i, "name": n, "input": {"command": n}} for i, n in (("1", "Zeta"), ("2", "Alpha"))]}}
    lines = [both, result("1", "bad z", True), result("2", "bad a", True), *[{"type": "user", "message": {"content": f"go on {i}"}} for i in range(4)]]
    p = tmp_path / "two.jsonl"
    p.write_text("\n".join(map(json.dumps, lines)))
    found = tr.process_findings(tr.build(read_lines(spark, str(p)))).filter("signal = 'unhandled_error'").orderBy("sort_key").collect()
    assert [(r.evidence, r.event_index, r.call_no) for r in found] == [("Zeta: bad z", 0, 0), ("Alpha: bad a", 0, 1)]


def test_every_tool_in_a_digest(spark, tmp_path):
    """Search, subagent and scratch calls are written as they are, the last ones not at all."""
    calls = [("Grep", {"pattern": "p", "path": "src"}), ("Glob", {"query": "*.ts"}), ("Grep", {}), ("Task", {"description": "d" * 120}), ("TodoWrite", {"todos": []}),
             ("Other", {"file_path": "x"}), ("Other", {}), ("Read", {"file_path": "f"}), ("Write", {"file_path": "w", "content": "y" * 2048}), ("replace", {"file_path": "r"})]
    p = tmp_path / "tools.jsonl"
    p.write_text("\n".join(json.dumps(call(str(i), n, **a)) for i, (n, a) in enumerate(calls)))
    got = [r.line for r in tr.rendered(tr.build(read_lines(spark, str(p)))).orderBy("idx").collect()]
    assert got == ['Grep "p" in src', 'Glob "*.ts"', 'Grep ""', "Subagent: " + "d" * 100, "Other x", "Other", "Read f", "Write w (2.0KB)", "replace r (0.0KB)"]


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("extended")
    return out.getvalue()


def test_only_strings_are_taken_for_strings(spark):
    """Numbers, booleans and objects are no texts, strings that look like them are."""
    values = ['"5"', "5", "-1.5e3", '"true"', "true", '"{x"', '{"x": 1}', '"[1]"', "[1]", '""', "null", '"a\\n"']
    strings = {i: json.loads(x) for i, x in enumerate(values) if x[0] == '"'}
    say = lambda kind, block, x: f'{{"type":"{kind}","sessionId":{x},"message":{{"content":[{block}]}}}}'
    lines = [(kind, n, say(kind, block.replace("?", x), x)) for kind, block in (
        ("assistant", '{"type":"tool_use","id":?,"name":"Read","input":?},{"type":"tool_use","id":"i","name":?},{"type":"text","text":?}'),
        ("user", '7,{"type":"tool_result","tool_use_id":?,"is_error":?,"content":?}')) for n, x in enumerate(values)]
    d = parse_lines(spark.createDataFrame(lines, "session string, pos long, line string")).collect()
    made, given = ({r.pos: r for r in d if r.kind == k} for k in ("assistant", "user"))
    for n, x in enumerate(values):
        s = strings.get(n)
        assert made[n].session_id == s and made[n].text == s and made[n].calls[0].id == s
        assert made[n].calls[0].input == ('{"x":1}' if x[0] == "{" else None) and [c.name for c in made[n].calls[1:]] == [s] * (s is not None)
        r = given[n].results[0]
        assert (r.id, r.is_error, r.content) == (s, x == "true", s or "")


def test_a_line_is_read_in_few_casts(spark):
    """Each field was fetched on its own, twice; and a filter that can be pushed trimmed the line again."""
    raw = spark.createDataFrame([("s", 1, "{}")], "session string, pos long, line string")
    usual = parse_lines(raw).select("session_id", "ts", "uuid", "model")
    heads = plan(usual).split("== Physical Plan ==")[1]
    assert heads.count("$.sessionId") <= 1 and "$.message.model" not in heads
    assert "Condition" not in heads and "regexp_replace" not in [x for x in heads.split("\n") if "Filter" in x][0]


def test_readers_take_only_their_columns(spark, tmp_path):
    t = build(spark, tmp_path)
    for d, not_asked in ((t.lines.select("session", "kind"), "results"), (t.events.select("session", "idx"), "thinking"), (t.calls.select("session", "key"), "input")):
        schema = [x for x in plan(d).split("\n") if "ReadSchema" in x]
        assert schema and not any(f"{not_asked}:" in x for x in schema)


def test_results_without_an_id_are_orphans(spark):
    """They have no call to go to, neither by an empty nor by a missing id, and stay in their place."""
    found = [call("", "Bash", command="x"), result("", "a"), {"type": "user", "message": {"content": [{"type": "tool_result", "content": "b"}]}}, result("1", "c")]
    raw = spark.createDataFrame([("s", n, json.dumps(x)) for n, x in enumerate(found)], "session string, pos long, line string")
    got = [(r.idx, r.name, r.result) for r in tr.build(raw).calls.orderBy("idx").collect()]
    assert got == [(0, "Bash", None), (1, tr.ORPHAN, "a"), (2, tr.ORPHAN, "b"), (3, tr.ORPHAN, "c")]


def test_rows_of_calls_and_events_are_never_broadcast(spark, monkeypatch):
    """A small file may hold many rows: sides with a row per call went whole through the driver because their file was small."""
    plans, write = [], tr.written

    def kept(df, name):
        plans.append(plan(df))
        return write(df, name)

    monkeypatch.setattr(tr, "written", kept)
    t = tr.build(spark.createDataFrame([("s", n, json.dumps(x)) for n, x in enumerate(LINES)], "session string, pos long, line string"))
    plans += [plan(x) for x in (t.calls, tr.process_findings(t), tr.session_stats(t), tr.digest(t))]
    small = [re.findall(r"(\w+)#", x) for p in plans for x in re.findall(r"BroadcastHashJoin \[([^]]*)\]", p.split("== Physical Plan ==")[1])]
    # One row per border of a block, or the number of a session with a long digest.
    assert [x for x in small if "_b" not in x and x != ["session"]] == []
    assert sum("SortMergeJoin" in p for p in plans) >= 5
