"""Driver queries over whole jobs: the scan with its merges, the data-flow analysis."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.operators import flow, packing, prompts, runtime, table_functions
from codewarden.operators.findings import ensemble_stats as ensemble
from codewarden.operators.findings import lens_counts
from codewarden.plans import flow as flow_plan
from codewarden.plans import review as review_plan
from codewarden.plans import scan
from codewarden.session import scratch_dir
from codewarden.sources import documents, folder, lenses, responses

from .files_checks import BUDGET, PACKED, files
from .files_checks import FX as FILES
from .files_checks import ORACLES as FILE_SQL
from .findings_checks import FX as FINDINGS
from .findings_checks import ORACLES as FINDING_SQL
from .findings_checks import findings, voted
from .fixtures import spark_fixture, with_fixtures
from .ingest_checks import ORACLES as INGEST_SQL
from .ingest_checks import review

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def tell(system: str, user: str) -> str:
    """One finding per file of a chunk, all in one place of the repository."""
    rows = []
    for path in re.findall(r"^  - (.+)$", user.split("## File Contents")[0], re.M):
        d = int(re.search(r"(\d+)\.\w+$", path).group(1))
        rows.append({"id": path, "severity": ["CRITICAL", "HIGH", "MEDIUM", "LOW"][d % 4], "category": f"c{d % 2}", "location": f"src/all.ts:{d * 37 % 200 + 1}",
                     "summary": f"issue w{d % 7} in w{d % 3} path w{d % 5}", "detail": "x" * (d % 50 + 1), "suggestion": "y" * (d % 9 + 1)})
    return json.dumps(rows)


MERGE_CTES, _, MERGE_SELECT = FINDING_SQL["scan_merge"][len(FINDINGS):].rpartition("\nSELECT run_id, id,")
TOLD = f"""{PACKED}, dm AS (SELECT repo, domain, row_number() OVER (PARTITION BY repo ORDER BY min(doc_id)) AS turn FROM z GROUP BY repo, domain),
findings_fx AS (SELECT pk.repo AS run_id, row_number() OVER (PARTITION BY pk.repo ORDER BY turn, chunk_no, rn) AS ord, path AS id, d,
  CASE d % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, concat('c', d % 2) AS category, 'src/all.ts' AS file, d * 37 % 200 + 1 AS line,
  concat('issue w', d % 7, ' in w', d % 3, ' path w', d % 5) AS summary, repeat('x', CAST(d % 50 + 1 AS INT)) AS detail, repeat('y', CAST(d % 9 + 1 AS INT)) AS suggestion,
  pk.domain AS lens, NULL::INT AS score, false AS deterministic
  FROM (SELECT *, CAST(regexp_extract(path, '([0-9]+)[.][a-z]+$', 1) AS BIGINT) AS d FROM pk) pk JOIN dm ON dm.repo = pk.repo AND dm.domain = pk.domain){MERGE_CTES}"""


@query("scan_findings", f"""{TOLD}, known AS (SELECT DISTINCT run_id, category, summary FROM findings_fx WHERE d % 3 = 0),
mg AS (SELECT run_id, id,{MERGE_SELECT})
SELECT mg.run_id AS repo, mg.id, mg.severity, mg.detail_len, mg.lenses, mg.merged_from, known.run_id IS NOT NULL AS suppressed
FROM mg JOIN findings_fx f ON f.run_id = mg.run_id AND f.id = mg.id LEFT JOIN known ON known.run_id = f.run_id AND known.category = f.category AND known.summary = f.summary""")
def scan_findings(spark, sf):
    f = files(spark, sf)
    n = F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long")
    known = f.filter(n % 3 == 0).select("repo", text.fingerprint(F.lit("src/all.ts:1"), F.concat(F.lit("c"), (n % 2).cast("string")), F.concat(
        F.lit("issue w"), (n % 7).cast("string"), F.lit(" in w"), (n % 3).cast("string"), F.lit(" path w"), (n % 5).cast("string"))).alias("fingerprint"))
    done = scan.scan(f, tell, scan.ScanOptions(budget_tokens=BUDGET, order="doc_id", scanners=()), known)
    both = done.merged.withColumn("suppressed", F.lit(False)).unionByName(done.suppressed.withColumn("suppressed", F.lit(True)))
    return both.select("repo", "id", "severity", F.length("detail").alias("detail_len"), F.array_join("lenses", ",").alias("lenses"), "merged_from", "suppressed")


CHANNEL = "patient.updated"


def profile(system: str, user: str) -> str:
    """Profiles of files on one channel: even ones read records, odd ones send them out; some answers are useless, some only at first."""
    if system == flow_plan.VERIFY_SYSTEM:
        return '{"isLeak": true, "confidence": "low", "explanation": "seen", "baaRelevant": false}'
    d = int(re.search(r"(\d+)\.\w+$", user.split("\n", 1)[0]).group(1))
    on = f"emit('{CHANNEL}'" in user
    if not on and (d % 10 == 8 or d % 10 == 9 and "could not be used" not in user):
        return "I cannot tell."
    body = {"sources": [], "sinks": [], "transforms": [], "exports": []}
    if on and d % 2 == 0:
        body["sources"] = [{"name": f"s{d}", "line": 1, "type": "db-query"}]
    if on and d % 2:
        body["sinks"] = [{"name": "k", "line": 2, "type": "log" if d % 4 == 1 else "external-api"}]
    return json.dumps(body)


@query("flow_job", f"""{FILES}, ch AS (SELECT repo, path, doc_id FROM files_fx WHERE contains(content, 'emit(''{CHANNEL}'''))
SELECT a.repo, 'leak' AS kind, concat(a.path, ':1 → ', b.path, ':2') AS place, CASE WHEN b.doc_id % 4 = 1 THEN 'HIGH' ELSE 'CRITICAL' END AS what
FROM ch a JOIN ch b ON a.repo = b.repo AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1
UNION ALL SELECT repo, 'refused', path, 'JSON parse error' FROM files_fx WHERE doc_id % 10 = 8 AND NOT contains(content, 'emit(''{CHANNEL}''') AND regexp_matches(content, '\\S')""")
def flow_job(spark, sf):
    f = files(spark, sf).select("repo", "path", "content")
    done = flow_plan.analyse(f, profile, flow_plan.FlowOptions(paths=None, files=1 << 30))
    return done.findings.select("repo", F.lit("leak").alias("kind"), F.col("location").alias("place"), F.col("severity").alias("what")).unionByName(
        done.refused.select("repo", F.lit("refused").alias("kind"), F.col("what").alias("place"), F.col("error").alias("what")))


def write_tree(f, root):
    """Files as real ones below a folder, and some that a listing has to leave out."""
    def put(rows):
        import os

        for r in rows:
            for path, body in ((r.path, r.content), *([(f"{r.repo}/node_modules/x/{r.doc_id}.ts", "skipped"), (f"lib/{r.doc_id}.min.js", "skipped")] if r.doc_id % 10 == 0 else [])):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8", newline="") as out:
                    out.write(body)

    f.select("repo", F.concat("repo", F.lit("/"), "path").alias("path"), "doc_id", "content").foreachPartition(put)


@query("corpus_folder", f"""{FILES} SELECT 'tree' AS repo, concat(repo, '/', path) AS path, strlen(content) AS size, CASE WHEN strlen(content) <= 102400 THEN sha256(content) END AS content_sha256 FROM files_fx""")
def corpus_folder(spark, sf):
    root = scratch_dir(spark, "tree")
    write_tree(files(spark, sf), root)
    d = folder.read_folder(spark, root, "tree", task_bytes=1 << 20)
    return d.select("repo", "path", "size", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


def read_back(spark, path, key, kind):
    """(key, d): the documents of a folder, parsed."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[a-z]+$", 1).alias(key), "value")
    return raw.select(key, F.from_json("value", kind).alias("d"))


def clean_runs(f):
    """All runs and one without findings, with their properties."""
    spark = f.sparkSession
    return f.select("run_id").distinct().unionByName(spark.range(99, 100).select(F.col("id").alias("run_id"))).select(
        "run_id", F.concat(F.lit("main-"), F.col("run_id").cast("string")).alias("branch"))


@query("sarif_files", f"""{FINDINGS}, r AS (SELECT DISTINCT run_id FROM findings_fx UNION ALL SELECT 99)
SELECT r.run_id::VARCHAR AS run_id, 'result' AS part, id AS name, concat_ws('|', CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END, file, line,
  concat(summary, chr(10), chr(10), detail, chr(10), chr(10), 'Suggestion: ', suggestion), category, severity, score, lens) AS body, row_number() OVER (PARTITION BY r.run_id ORDER BY ord) AS n FROM findings_fx JOIN r USING (run_id)
UNION ALL SELECT run_id::VARCHAR, 'rule', id, concat_ws('|', summary, detail, suggestion, lens), row_number() OVER (PARTITION BY run_id ORDER BY ord) FROM findings_fx
UNION ALL SELECT run_id::VARCHAR, 'run', '2.1.0', concat('main-', run_id), 1 FROM r""")
def sarif_files(spark, sf):
    f = findings(spark, sf)
    path = scratch_dir(spark, "sarif")
    documents.write(documents.sarif_document(clean_runs(f), f), path, ending=".sarif")
    items, frames = documents.read_flat(spark, path)
    place = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>"
    rule = "id string, shortDescription struct<text:string>, fullDescription struct<text:string>, help struct<text:string>, properties struct<tags:array<string>>"
    result = (f"ruleId string, level string, message struct<text:string>, locations array<{place}>, "
              "properties struct<category:string,severity:string,confidence:int,lenses:array<string>>")
    row = lambda what, name, *body: F.struct(F.lit(what).alias("part"), name.alias("name"), F.concat_ws("|", *body).alias("body"))
    of_rule = F.col("section") == 1
    d = items.withColumn("y", F.when(of_rule, F.from_json("body", rule))).withColumn("x", F.when(~of_rule, F.from_json("body", result)))
    where = F.col("x.locations")[0]["physicalLocation"]
    told = F.when(of_rule, row("rule", F.col("y.id"), "y.shortDescription.text", "y.fullDescription.text", "y.help.text", F.array_join("y.properties.tags", ","))).otherwise(
        row("result", F.col("x.ruleId"), "x.level", where["artifactLocation"]["uri"], where["region"]["startLine"].cast("string"), "x.message.text", "x.properties.category",
            "x.properties.severity", F.col("x.properties.confidence").cast("string"), F.array_join("x.properties.lenses", ",")))
    # The lines around the rules and the results hold the version and, at the end, the invocation.
    head, tail = F.get("frame", F.lit(0)), F.element_at("frame", -1)
    call = F.from_json(F.concat(F.lit("{"), F.substr(tail, F.lit(3), F.length(tail) - 4)), "invocations array<struct<properties:struct<branch:string>>>")
    runs = frames.select(F.col("name").alias("run_id"), row("run", F.regexp_extract(head, r'"version":"([^"]*)"', 1), call["invocations"][0]["properties"]["branch"]).alias("t"), F.lit(1).cast("long").alias("n"))
    return d.select(F.col("name").alias("run_id"), told.alias("t"), F.col("n").cast("long").alias("n")).unionByName(runs).select("run_id", "t.part", "t.name", "t.body", "n")


@query("review_documents", f"""{FINDINGS}, r AS (SELECT DISTINCT run_id FROM findings_fx UNION ALL SELECT 99)
SELECT run_id::VARCHAR AS run_id, 'finding' AS part, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS n, concat_ws('|', id, severity, location, summary, detail, score) AS body FROM findings_fx
UNION ALL SELECT run_id::VARCHAR, 'lens', 0, concat_ws('|', lens, count(*)) FROM findings_fx GROUP BY run_id, lens
UNION ALL SELECT run_id::VARCHAR, 'head', 0, concat('main-', run_id) FROM r""")
def review_documents(spark, sf):
    f = findings(spark, sf)
    path = scratch_dir(spark, "reviews")
    documents.write(documents.review_document(clean_runs(f), f.select("run_id", "ord", "id", "severity", "location", "summary", "detail", "score"), lens_counts(f)), path)
    items, frames = documents.read_flat(spark, path)
    of_finding = F.col("section") == 2  # after the header and the line that opens the findings
    d = items.withColumn("x", F.when(of_finding, F.from_json("body", "id string, severity string, location string, summary string, detail string, score int"))).withColumn(
        "l", F.when(~of_finding, F.from_json("body", "lens string, findings bigint")))
    told = F.when(of_finding, F.concat_ws("|", "x.id", "x.severity", "x.location", "x.summary", "x.detail", F.col("x.score").cast("string"))).otherwise(
        F.concat_ws("|", "l.lens", F.col("l.findings").cast("string")))
    rows = d.select(F.col("name").alias("run_id"), F.when(of_finding, "finding").otherwise("lens").alias("part"), F.when(of_finding, F.col("n")).otherwise(0).cast("long").alias("n"), told.alias("body"))
    # The first line is the header, left open for the sections that follow.
    head = F.from_json(F.concat(F.get("frame", F.lit(0)), F.lit("}")), "branch string")
    return rows.unionByName(frames.select(F.col("name").alias("run_id"), F.lit("head").alias("part"), F.lit(0).cast("long").alias("n"), head["branch"].alias("body")))


@query("scan_documents", f"""{TOLD}
SELECT run_id AS repo, 'raw' AS part, concat(lens, '/', chunk_id) AS place, row_number() OVER (PARTITION BY run_id, lens, chunk_id ORDER BY ord) AS n, concat_ws('|', id, severity, detail) AS body
FROM (SELECT f.*, concat(f.lens, '-', lpad(CAST(pk.chunk_no AS VARCHAR), 3, '0')) AS chunk_id FROM findings_fx f JOIN pk ON pk.repo = f.run_id AND pk.path = f.id) q
UNION ALL SELECT repo, 'domain', domain, 0, CAST(count(*) AS VARCHAR) FROM pk GROUP BY repo, domain
UNION ALL SELECT repo, 'head', '', 0, concat_ws('|', count(DISTINCT concat(domain, '-', chunk_no)), count(*)) FROM pk GROUP BY repo""")
def scan_documents(spark, sf):
    done = scan.scan(files(spark, sf), tell, scan.ScanOptions(budget_tokens=BUDGET, order="doc_id", scanners=()))
    path = scratch_dir(spark, "scans")
    raw = done.raw.select("repo", "domain", "chunk_id", "n", "id", "severity", "detail")
    totals = done.totals.select("repo", "chunks", F.col("scanned").alias("files"))
    documents.write(documents.scan_document(totals, done.chunks, raw, done.merged.select("repo", "ord", "id", "severity"), done.coverage.select("repo", "domain", "files_scanned")), path, "repo")
    one = "struct<id:string,severity:string,detail:string>"
    kind = f"chunks array<struct<domain:string,chunk_id:string,findings:array<{one}>>>, findings array<{one}>, coverage array<struct<domain:string,files_scanned:bigint>>"
    named = read_back(spark, path, "repo", kind)
    heads = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("repo"), F.from_json(
        F.regexp_replace("value", r'(?s)"chunks":\[.*', r'"x":0}'), "chunks bigint, files bigint").alias("h"))
    chunk = named.select("repo", F.explode("d.chunks").alias("c")).select("repo", F.concat("c.domain", F.lit("/"), "c.chunk_id").alias("place"), F.posexplode("c.findings").alias("n", "x"))
    row = lambda df, part, place, n, body: df.select("repo", F.lit(part).alias("part"), place.alias("place"), n.cast("long").alias("n"), body.alias("body"))
    return (row(chunk, "raw", F.col("place"), F.col("n") + 1, F.concat_ws("|", "x.id", "x.severity", "x.detail"))
            .unionByName(row(named.select("repo", F.explode("d.coverage").alias("c")), "domain", F.col("c.domain"), F.lit(0), F.col("c.files_scanned").cast("string")))
            .unionByName(row(heads, "head", F.lit(""), F.lit(0), F.concat_ws("|", F.col("h.chunks").cast("string"), F.col("h.files").cast("string")))))


TR = with_fixtures("trace_fx")


@query("trace_documents", f"""{TR} SELECT session::VARCHAR AS session, count(*) AS events, count(*) FILTER (is_prompt) AS prompts FROM trace_fx GROUP BY session""")
def trace_documents(spark, sf):
    t = spark_fixture(spark, sf, "trace_fx")
    stats = t.groupBy("session").agg(F.count(F.lit(1)).alias("events"))
    tools = t.groupBy("session", "is_prompt").agg(F.count(F.lit(1)).alias("calls"))
    errors = t.filter("is_error").select("session", F.col("event_id").alias("ord"), "tool")
    path = scratch_dir(spark, "sessions")
    documents.write(documents.trace_document(stats, tools, errors), path, "session")
    d = read_back(spark, path, "session", "events bigint, tools array<struct<is_prompt:boolean,calls:bigint>>, findings array<struct<tool:string>>")
    prompts = F.aggregate("d.tools", F.lit(0).cast("long"), lambda a, x: a + F.when(x["is_prompt"], x["calls"]).otherwise(0))
    return d.select("session", "d.events", prompts.alias("prompts"))


# Runs ask for some lenses, one run for all; a custom lens repeats a built-in id.
BUILTIN = [("security", "S", "find holes", 0), ("architecture", "A", "find knots", 1), ("quality", "Q", "find slips", 2), ("hipaa", "H", "find leaks", 3)]
CUSTOM = [("quality", "other", "never used", 0), ("perf", "P", "find waits", 1)]
LENSES = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {i})" for i, (a, b, c, _) in enumerate([*BUILTIN, CUSTOM[1]])) + ") c(id, name, system_prompt, place)"
ASKED = f"""{FINDINGS}, rq AS (SELECT run_id, lens, min(ord) AS ord FROM (SELECT run_id, CASE WHEN ord % 13 = 0 THEN 'perf' WHEN ord % 17 = 0 THEN 'hipaa' WHEN ord % 19 = 0 THEN 'ghost' ELSE lens END AS lens, ord
  FROM findings_fx UNION ALL SELECT run_id, 'all', 5 FROM findings_fx WHERE run_id = 3) q GROUP BY run_id, lens),
rs AS (SELECT run_id, id AS lens, name, system_prompt, min({{'a': ord, 'b': CASE WHEN lens = 'all' THEN place ELSE -1 END}}) AS at_ FROM rq JOIN {LENSES} ON rq.lens = c.id OR rq.lens = 'all' GROUP BY run_id, id, name, system_prompt)"""


def asked(spark, sf):
    f = findings(spark, sf)
    lens = F.when(F.col("ord") % 13 == 0, "perf").when(F.col("ord") % 17 == 0, "hipaa").when(F.col("ord") % 19 == 0, "ghost").otherwise(F.col("lenses")[0])
    requests = f.select("run_id", lens.alias("lens"), "ord").unionByName(f.filter("run_id = 3").select("run_id", F.lit("all").alias("lens"), F.lit(5).cast("long").alias("ord")))
    kind = "id string, name string, system_prompt string, ord int"
    known = lenses.catalogue(spark.createDataFrame(BUILTIN, kind), spark.createDataFrame(CUSTOM, kind))
    return lenses.resolve(requests.groupBy("run_id", "lens").agg(F.min("ord").alias("ord")), known)


@query("lens_resolution", f"""{ASKED} SELECT run_id, lens, name, row_number() OVER (PARTITION BY run_id ORDER BY at_, lens) AS ord FROM rs""")
def lens_resolution(spark, sf):
    return asked(spark, sf).select("run_id", "lens", "name", "ord")


NL = "chr(10)"
BLOCK = f"""concat('## BAA Registry', {NL}, {NL}, 'These services have signed a Business Associate Agreement (BAA):', {NL}, '- *.run', run_id, '.test', {NL}, {NL},
 'These services have NO BAA; PHI must not be sent to them:', CASE WHEN run_id % 2 = 0 THEN concat({NL}, '- evil', run_id, '.test') ELSE '' END, {NL}, {NL}, '**Rules:**', {NL},
 '- Report PHI sent to a service without a BAA as HIGH or CRITICAL.', {NL}, '- Report a service that is in neither list as unknown BAA status, MEDIUM.', {NL},
 '- PHI may go to covered services if it is encrypted on the way.', CASE WHEN run_id % 3 = 0 THEN concat({NL}, {NL}, '## Project-Specific PHI Fields', {NL}, {NL}, 'Besides the standard fields watch for these:', {NL}, '- `zeta`', {NL}, '- `alpha`') ELSE '' END)"""


def blocks(spark, sf):
    runs = findings(spark, sf).select("run_id").distinct()
    name = lambda a: F.concat(F.lit(a), F.col("run_id").cast("string"), F.lit(".test"))
    registry = runs.select("run_id", name("*.run").alias("pattern"), F.lit("covered").alias("status")).unionByName(
        runs.filter("run_id % 2 = 0").select("run_id", name("evil").alias("pattern"), F.lit("no-baa").alias("status")))
    own = runs.filter("run_id % 3 = 0").select("run_id", F.explode(F.array(F.struct(F.lit("zeta").alias("field"), F.lit(0).alias("ord")), F.struct(F.lit("alpha").alias("field"), F.lit(1).alias("ord")))).alias("x"))
    return prompts.context_block(registry, own.select("run_id", "x.*"))


@query("review_prompts", f"""{ASKED}, rv AS (SELECT run_id, count(*) AS n, sum(score) AS diff_n FROM findings_fx GROUP BY run_id)
SELECT run_id, lens, md5(concat(system_prompt, {NL}, {NL}, '{prompts.ANSWER_FORM}')) AS system_md5, md5(concat('PR #', run_id, ': title {{body}}', {NL}, 'Repository: o/r', {NL}, 'Author: ', {NL}, 'Base branch: main ← f', run_id, {NL},
 'Labels: ', CASE WHEN run_id % 2 = 0 THEN '(none)' ELSE 'a, b' END, {NL}, 'Stats: +', n, ' additions / -', diff_n, ' deletions', {NL},
 CASE run_id % 4 WHEN 1 THEN concat('⚠️ This is a DRAFT PR.', {NL}) WHEN 2 THEN concat('ℹ️ This PR is already merged.', {NL}) WHEN 3 THEN concat('⚠️ This is a DRAFT PR.', {NL}, 'ℹ️ This PR is closed.', {NL}) ELSE '' END,
 {NL}, '## PR Description', {NL}, CASE WHEN run_id % 3 = 0 THEN '(no description provided)' ELSE 'text' END, {NL}, {NL}, '## Changed Files (', n, ' files)', {NL}, 'files', {NL},
 CASE WHEN run_id % 5 = 0 THEN concat({NL}, '⚠️ cut', {NL}) ELSE '' END, {NL}, '## Diff', {NL}, repeat('d', CAST(n AS INT)), CASE WHEN lens = 'hipaa' THEN concat({NL}, {NL}, '## HIPAA Configuration Context', {NL}, {BLOCK}) ELSE '' END)) AS user_md5
FROM rs JOIN rv USING (run_id)""")
def review_prompts(spark, sf):
    r, text_of = F.col("run_id"), lambda c: c.cast("string")
    reviews = findings(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("score").alias("deletions")).withColumns({
        "number": r, "title": F.lit("title {body}"), "repository": F.lit("o/r"), "author": F.lit(None).cast("string"), "base": F.lit("main"), "head": F.concat(F.lit("f"), text_of(r)),
        "labels": F.when(r % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))), "additions": F.col("n_files"), "draft": r % 2 == 1,
        "state": F.when(r % 4 == 2, "merged").when(r % 4 == 3, "closed").otherwise("open"), "body": F.when(r % 3 == 0, "").otherwise("text"), "file_list": F.lit("files"),
        "note": F.when(r % 5 == 0, "cut"), "diff": F.expr("repeat('d', cast(n_files as int))")})
    d = prompts.review_prompts(reviews, asked(spark, sf), blocks(spark, sf))
    return d.select("run_id", "lens", F.md5("system").alias("system_md5"), F.md5("user").alias("user_md5"))


def packed_sql(context: int) -> str:
    """Fates, then texts: the whole diff where it fits, else packed sections and omitted lines."""
    ctes, _, _ = INGEST_SQL["diff_packing"].replace("4600 - 4000", f"{context} - 4000").rpartition("\nSELECT sz.run_id")
    omitted = "concat('[diff omitted — too large] ', filename, ' (modified, +', additions, '/-', deletions, ' lines)')"
    return f"""{ctes}, fa AS (SELECT sz.*, CASE WHEN skip THEN 'skipped' WHEN took THEN 'packed' ELSE 'summary' END AS fate, length(concat('- ', filename, ' (modified, +', additions, '/-', deletions, ')')) AS ll
  FROM sz LEFT JOIN fo USING (run_id, filename)),
pr AS (SELECT run_id, concat('preamble', chr(10), string_agg(sec, '' ORDER BY file_ord)) AS whole, string_agg(rtrim(sec, chr(10)), chr(10) ORDER BY changes, file_ord) FILTER (fate = 'packed') AS pk,
  string_agg({omitted}, chr(10) ORDER BY changes, file_ord) FILTER (fate = 'summary') AS om, list(filename ORDER BY changes, file_ord) FILTER (fate = 'summary' AND sec IS NOT NULL) AS dr,
  coalesce(list_sort(list(filename) FILTER (skip)), []) AS sk, coalesce(sum(t) FILTER (fate = 'packed'), 0) AS used, ceil((sum(ll + 1) - 1) / 4) AS lt FROM fa GROUP BY run_id),
p2 AS (SELECT *, ceil(length(whole) / 4) <= {context} - 4000 - lt AS fits FROM pr)
SELECT {context} AS context, run_id, md5(CASE WHEN fits THEN whole ELSE concat(coalesce(pk, ''), CASE WHEN om IS NOT NULL THEN concat(chr(10), chr(10), '--- Omitted files (summary only) ---', chr(10), om) ELSE '' END) END) AS diff_md5,
  NOT fits AND coalesce(len(dr), 0) > 0 AS truncated, CASE WHEN NOT fits AND coalesce(len(dr), 0) > 0 THEN concat('[TRUNCATED] ', len(dr), ' file(s) omitted due to context limits: ', array_to_string(dr[1:5], ', '),
  CASE WHEN len(dr) > 5 THEN concat(' and ', len(dr) - 5, ' more') ELSE '' END) END AS note, array_to_string(sk, ',') AS skipped, CAST(lt + CASE WHEN fits THEN ceil(length(whole) / 4) ELSE used END AS BIGINT) AS tokens FROM p2"""


@query("packed_reviews", f"SELECT * FROM ({packed_sql(4600)}) UNION ALL SELECT * FROM ({packed_sql(1000000)})")
def packed_reviews(spark, sf):
    c, diffs = review(spark, sf)
    sections = packing.diff_sections(diffs)
    out = None
    for context in (4600, 1000000):
        packed_ = packing.pack_diff(packing.attach_sections(c, sections), context, size=packing.diff_size(sections))
        d = packing.packed_review(packed_, sections).select(F.lit(context).alias("context"), "run_id", F.md5("diff").alias("diff_md5"), "truncated", "note",
                                                            F.array_join("skipped", ",").alias("skipped"), "tokens")
        out = d if out is None else out.unionByName(d)
    return out


def marks(path: str, content: str):
    """Lines that mention a router, and who is to look at them."""
    if path.endswith(".md"):
        raise ValueError("no code")
    for n, line in enumerate(content.split("\n"), 1):
        if "router." in line:
            yield {"line": n, "severity": "LOW", "category": "Notes", "summary": f"route of {len(line)}", "owner": path.split("/")[1], "unknown": 1}


@query("custom_scanners", f"""{FILES}, l AS (SELECT repo, path, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT repo, path, string_split(content, chr(10)) AS x FROM files_fx WHERE path NOT LIKE '%.md'))
SELECT repo, path, line, 'LOW' AS severity, concat('route of ', length(t)) AS summary, split_part(path, '/', 2) AS owner, NULL AS error FROM l WHERE contains(t, 'router.')
UNION ALL SELECT repo, path, NULL, NULL, NULL, NULL, 'no code' FROM files_fx WHERE path LIKE '%.md'""")
def custom_scanners(spark, sf):
    table_functions.register(spark, "route_marks", marks)
    return spark.sql("SELECT f.repo, f.path, s.line, s.severity, s.summary, s.owner, s.error FROM {files} f, LATERAL route_marks(f.path, f.content, more => 'owner') s", files=files(spark, sf))


@query("ensemble_stats", f"""{FINDINGS}, m AS (SELECT run_id, count(DISTINCT model) + 1 AS models_run, count(DISTINCT model) AS models_succeeded FROM findings_fx GROUP BY run_id UNION ALL SELECT 99, 1, 0),
rw AS (SELECT run_id, count(*) AS raw FROM findings_fx GROUP BY run_id), vt AS ({FINDING_SQL['model_vote']}),
ag AS (SELECT run_id, count(*) AS merged, count(*) FILTER (agreement = 4) AS unanimous, count(*) FILTER (agreement > 1 AND agreement < 4) AS majority, count(*) FILTER (agreement = 1) AS single FROM vt GROUP BY run_id)
SELECT run_id, models_run, models_succeeded, coalesce(raw, 0) AS raw, coalesce(merged, 0) AS merged, coalesce(unanimous, 0) AS unanimous, coalesce(majority, 0) AS majority, coalesce(single, 0) AS single
FROM m LEFT JOIN rw USING (run_id) LEFT JOIN ag USING (run_id)""")
def ensemble_stats(spark, sf):
    f = findings(spark, sf)
    runs = f.select("run_id", "model", F.lit(None).cast("string").alias("error")).distinct()
    broken = f.select("run_id").distinct().unionByName(spark.range(99, 100).select(F.col("id").alias("run_id"))).select("run_id", F.lit("m9").alias("model"), F.lit("timeout").alias("error"))
    return ensemble(runs.unionByName(broken), voted(spark, sf), f)


@query("runtime_profiles", f"""{FILES}, rt AS ({FILE_SQL['runtime_flows']}),
ca AS (SELECT repo, path, string_agg(concat_ws(':', kind, channel, function_name, line), ',' ORDER BY kind, line, channel, function_name) AS calls FROM rt GROUP BY repo, path),
pf AS (SELECT repo, path, doc_id FROM files_fx WHERE path LIKE '%.ts')
SELECT coalesce(pf.repo, ca.repo) AS repo, coalesce(pf.path, ca.path) AS path, CASE WHEN pf.path IS NULL THEN '' ELSE concat('s', pf.doc_id) END AS sources,
concat_ws(',', CASE WHEN pf.path IS NOT NULL THEN 'event-emit:own:f:7' END, calls) AS calls FROM pf FULL JOIN ca ON pf.repo = ca.repo AND pf.path = ca.path""")
def runtime_profiles(spark, sf):
    f = files(spark, sf)
    raw = F.concat(F.lit('{"sources":[{"name":"s'), F.col("doc_id").cast("string"), F.lit(
        '","line":1,"type":"db-query"}],"sinks":[],"transforms":[],"exports":[],"runtimeFlows":[{"type":"event-emit","channel":"own","functionName":"f","line":7}]}'))
    profiles = responses.ingest_profiles(f.filter(F.col("path").endswith(".ts")).select("repo", "path", raw.alias("raw")), ["repo", "path"]).select("repo", "path", "profile")
    d = flow.merge_calls(profiles, runtime.runtime_flows(f.select("repo", "path", "content")))
    call = lambda c: F.concat_ws(":", c["type"], c["channel"], c["functionName"], c["line"].cast("int").cast("string"))
    return d.select("repo", "path", F.array_join(F.transform("profile.sources", lambda s: s["name"]), ",").alias("sources"),
                    F.array_join(F.transform("profile.runtimeFlows", call), ",").alias("calls"))


def reviewer(system: str, user: str) -> str:
    """Each lens tells one thing that all of them see and one of its own; odd ids are doubted, and one lens fails."""
    if system == review_plan.SCORE_SYSTEM:
        ids = re.findall(r'"id":"([^"]+)"', user.split("## Evidence")[0])
        return json.dumps({"scores": [{"id": i, "confidenceScore": 90 if len(i) % 2 == 0 else 10} for i in ids]})
    if system.startswith("find waits"):
        raise ValueError("too slow")
    if system.startswith("find leaks"):
        return "nothing to say"
    own = system.split()[1][:5]
    row = lambda i, severity, summary: {"id": i, "severity": severity, "category": "c", "location": "src/a.ts:1", "summary": summary, "detail": f"by {own}", "suggestion": "s"}
    return json.dumps([row("common", "MEDIUM", "seen by all"), row(f"own-{own}", "HIGH", f"only {own} {own}{own} says this")])


@query("review_job", f"""{ASKED}, ok AS (SELECT run_id, lens, substr(split_part(system_prompt, ' ', 2), 1, 5) AS own, row_number() OVER (PARTITION BY run_id ORDER BY at_, lens) AS o FROM rs),
fn AS (SELECT run_id, 'common' AS id, string_agg(lens, ',' ORDER BY o) AS lenses, 'MEDIUM' AS severity FROM ok WHERE lens IN ('security', 'architecture', 'quality') GROUP BY run_id
  UNION ALL SELECT run_id, concat('own-', own), lens, 'HIGH' FROM ok WHERE lens IN ('security', 'architecture', 'quality'))
SELECT run_id, 'finding' AS part, id AS name, concat_ws('|', severity, lenses, CASE WHEN length(id) % 2 = 0 THEN 'confirmed' ELSE 'disproven' END) AS body FROM fn
UNION ALL SELECT run_id, 'failed', lens, CASE WHEN lens = 'perf' THEN 'too slow' ELSE '[PARSE ERROR] hipaa lens returned garbled response — results may be incomplete' END FROM ok WHERE lens IN ('perf', 'hipaa')
UNION ALL SELECT run_id, 'gate', '', CASE WHEN bool_or(severity = 'HIGH' AND length(id) % 2 = 0) THEN 'true' ELSE 'false' END FROM fn GROUP BY run_id""")
def review_job(spark, sf):
    c, diffs = review(spark, sf)
    r = F.col("run_id")
    meta = c.select("run_id").distinct().withColumns({
        "number": r, "title": F.lit("t"), "repository": F.lit("o/r"), "author": F.lit("a"), "base": F.lit("main"), "head": F.lit("f"), "labels": F.array(F.lit("l")), "additions": F.lit(1),
        "deletions": F.lit(1), "draft": F.lit(False), "state": F.lit("open"), "body": F.lit("b")})
    done = review_plan.review(meta, c, diffs, asked(spark, sf), reviewer, review_plan.ReviewOptions(context_tokens=4600, batch=3), blocks(spark, sf))
    row = lambda df, part, name, body: df.select("run_id", F.lit(part).alias("part"), name.alias("name"), body.alias("body"))
    return (row(done.merged, "finding", F.col("id"), F.concat_ws("|", "severity", F.array_join("lenses", ","), "disposition"))
            .unionByName(row(done.failed, "failed", F.col("lens"), F.col("message")))
            .unionByName(row(done.gate, "gate", F.lit(""), F.col("failed").cast("string"))))
