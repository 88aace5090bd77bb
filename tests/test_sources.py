import json

from pyspark.sql import functions as F

from codewarden.operators import redact, rules, scanners
from codewarden.sources import baseline, corpus, exports, lenses, responses


def test_corpus_skips_and_limits(spark, tmp_path):
    for name, body in {"src/a.ts": "x", "node_modules/b.ts": "x", "c.min.js": "x", "Cargo.lock": "x", "big.ts": "y" * 102401}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    got = {r.path: (r.size, r.content) for r in corpus.read_files(spark, str(tmp_path), "r").collect()}
    assert got == {"src/a.ts": (1, "x"), "big.ts": (102401, None)}
    assert {r.path for r in corpus.list_files(spark, str(tmp_path), "r").collect()} == set(got)


def test_missing_baseline_is_empty(spark, tmp_path):
    assert baseline.read(spark, str(tmp_path / "none")).count() == 0


def test_sarif_text_is_one_document_per_run(spark, tmp_path):
    f = spark.createDataFrame([(r, i, f"f{i % 3}", "HIGH", "c", "a.ts:4", "s", "d", "g", ["q"], 5) for r in (1, 2) for i in range(7)],
                              "run_id int, ord long, id string, severity string, category string, location string, summary string, detail string, suggestion string, lenses array<string>, score int")
    out = tmp_path / "sarif"
    exports.write_documents(exports.sarif_lines(f), str(out))
    for run in (1, 2):
        text = "".join(p.read_text() for p in sorted((out / f"run_id={run}").glob("part-*")))
        log = json.loads(text)["runs"][0]
        assert len(log["tool"]["driver"]["rules"]) == 3 and len(log["results"]) == 7
        assert log["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 4


def test_lens_folder(spark, tmp_path):
    good = {"id": "x", "name": "n", "description": "d", "systemPrompt": "p", "focusAreas": ["a"]}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.json").write_text("{")
    got = {r.id: r.reason for r in lenses.validate(lenses.read(spark, str(tmp_path))).collect()}
    assert got == {"x": None, None: "must be a JSON object"}


def test_profile_errors_name_the_place(spark):
    ok = '{"sources":[{"name":"a","line":1,"type":"cda"}],"sinks":[],"transforms":[],"exports":[{"name":"e","containsPhi":true}]}'
    rows = [(1, f"prose {{x}} {ok}"), (2, ok.replace("cda", "zzz")), (3, '{"sources":[]}'), (4, "nothing")]
    got = {r.k: (r.profile is not None, r.error) for r in responses.ingest_profiles(spark.createDataFrame(rows, "k int, raw string"), ["k"]).collect()}
    assert got[1] == (True, None) and "sources.0.type" in got[2][1] and "- sinks: Required" in got[3][1] and got[4][1] == "JSON parse error"


def test_redaction_order_and_entropy(spark):
    key = "sk-ant-" + "a" * 20
    rows = [(f'k="{key}" x="abcdefghijklmnopqrstuvwxyz012345"',), ('y="' + "a" * 40 + '"',), ("plain",)]
    got = redact.redact(spark.createDataFrame(rows, "content string")).select("redacted", "redactions").collect()
    assert [tuple(r) for r in got] == [('k="[REDACTED_ANTHROPIC_KEY]" x="[REDACTED_HIGH_ENTROPY]"', 2), ('y="[REDACTED_AWS_SECRET]"', 1), ("plain", 0)]


def test_scanner_switches_and_overlays(spark):
    files = spark.createDataFrame([("r", "src/care/a.ts", "logger.info(x.careId)\nfetch('http://h.test/a')\n"), ("r", "a.test.ts", "console.log(ssn)")], "repo string, path string, content string")
    run = lambda **o: sorted((r.scanner_id, r.line_no) for r in rules.scan_files(files, scanners.STOCK, rules.RuleOptions(**o)).collect())
    assert run() == []
    assert run(phi_fields=("careId",), phi_paths=("src/care/*",)) == [("http-phi", 2), ("phi-in-logs", 1)]
    assert run(phi_fields=("careId",), phi_paths=("src/care/*",), disabled=frozenset({"http-phi"})) == [("phi-in-logs", 1)]
    assert run(skip_tests=False) == [("phi-in-logs", 1)]


def test_custom_scanner(spark):
    todo = rules.Scanner("todo", "To-do marks", lambda p, o: F.lit(True), ("todo",), lambda h, v: [rules.one(
        h.line.contains("TODO"), "LOW", "Notes", "open task", "d", "s", "none")])
    files = spark.createDataFrame([("r", "a.py", "x\n# TODO: y")], "repo string, path string, content string")
    assert [(r.id, r.severity) for r in rules.scan_files(files, [todo]).collect()] == [("todo-a-py-2", "LOW")]
