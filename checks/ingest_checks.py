"""Driver queries over responses, lens files, review diffs and prompts."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.operators import inference, packing
from codewarden.session import scratch_dir
from codewarden.sources import baseline, lenses, responses

from .files_checks import files
from .findings_checks import CHANGED_FX, FP, FX, SEV, findings
from .fixtures import spark_fixture, spark_table, with_fixtures

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


# One response per finding, in nine shapes.
FIELDS = ["id", "severity", "category", "location", "summary", "detail", "suggestion"]


def raw_responses(spark, sf):
    f = findings(spark, sf).withColumn("detail", F.lit("d [x] \"q\""))
    one = F.to_json(F.struct(*FIELDS))
    bad = F.to_json(F.struct("id", "severity"))
    shape = F.col("ord") % 9
    raw = (F.when(shape == 0, F.concat(F.lit("["), one, F.lit("]")))
           .when(shape == 1, F.concat(F.lit('{"findings":['), one, F.lit("]}")))
           .when(shape == 2, F.concat(F.lit("Sure:\n```json\n["), one, F.lit("]\n```\nbye")))
           .when(shape == 3, F.concat(F.lit("Here they are: ["), one, F.lit(","), bad, F.lit("] as asked [1]")))
           .when(shape == 4, F.concat(F.lit("[ "), one, F.lit(" , ] // done")))
           .when(shape == 5, F.lit(" [] "))
           .when(shape == 6, F.concat(F.lit("["), bad, F.lit("]")))
           .when(shape == 7, F.lit("I could not review this."))
           .otherwise(F.concat(F.lit("```\n["), one, F.lit(",]\n```"))))
    return f.select("run_id", "ord", F.col("lenses")[0].alias("lens"), raw.alias("raw"))


GOOD = "ord % 9 IN (0, 1, 2, 3, 4, 8)"


@query("response_status", f"""{FX} SELECT run_id, ord, CAST(CASE WHEN {GOOD} THEN 1 WHEN ord % 9 = 5 THEN 0 END AS INT) AS items, CAST(CASE WHEN ord % 9 = 3 THEN 1 WHEN {GOOD} OR ord % 9 = 5 THEN 0 END AS INT) AS dropped,
CASE ord % 9 WHEN 6 THEN concat('[PARSE ERROR] ', lens, ' lens returned 1 finding(s) but none passed validation — results may be incomplete')
WHEN 7 THEN concat('[PARSE ERROR] ', lens, ' lens returned garbled response — results may be incomplete') END AS message FROM findings_fx""")
def response_status(spark, sf):
    d = responses.ingest_findings(raw_responses(spark, sf), ["run_id", "ord", "lens"])
    return d.select("run_id", "ord", F.when(F.col("items").isNotNull(), F.size("items")).alias("items"), "dropped", "message")


@query("response_findings", f"{FX} SELECT run_id, ord, id, severity, category, location, summary, 'd [x] \"q\"' AS detail, suggestion FROM findings_fx WHERE {GOOD}")
def response_findings(spark, sf):
    d = responses.ingest_findings(raw_responses(spark, sf), ["run_id", "ord", "lens"])
    return responses.explode_findings(d, ["run_id", "ord", "lens"]).select("run_id", "ord", *FIELDS)


@query("score_ingest", f"""{FX} SELECT run_id, ord, id, CAST(greatest(0, least(100, floor(k2 + 0.5))) AS INT) AS score FROM (SELECT *, (score * 3 - 60) / 2.0 AS k2 FROM findings_fx) q WHERE ord % 5 <> 4""")
def score_ingest(spark, sf):
    f = findings(spark, sf)
    rec = F.to_json(F.struct("id", ((F.col("score") * 3 - 60) / 2).alias("confidenceScore")))
    odd = F.to_json(F.struct("id", F.lit("high").alias("confidenceScore")))
    s = F.col("ord") % 5
    raw = (F.when(s == 0, F.concat(F.lit('{"scores":['), rec, F.lit("]}"))).when(s == 1, F.concat(F.lit("```JSON\n["), rec, F.lit("]\n```")))
           .when(s == 2, F.concat(F.lit("scores: ["), rec, F.lit(","), odd, F.lit("] end"))).when(s == 3, F.concat(F.lit("["), rec, F.lit("]")))
           .otherwise(F.lit("none")))
    return responses.ingest_scores(f.select("run_id", "ord", raw.alias("raw")), ["run_id", "ord"]).select("run_id", "ord", "id", "score")


@query("verdict_ingest", f"{FX} SELECT run_id, ord, id AS finding_id, score > 50 AS passed, CASE WHEN ord % 2 = 0 THEN 'slow' ELSE '' END AS issues FROM findings_fx WHERE ord % 3 <> 2")
def verdict_ingest(spark, sf):
    f = findings(spark, sf)
    issues = F.when(F.col("ord") % 2 == 0, F.array(F.lit("slow"))).otherwise(F.array().cast("array<string>"))
    rec = F.to_json(F.struct(F.col("id").alias("findingId"), (F.col("score") > 50).alias("passed"), issues.alias("issues")))
    s = F.col("ord") % 3
    raw = F.when(s == 0, F.concat(F.lit('{"results":['), rec, F.lit("]}"))).when(s == 1, F.concat(F.lit("So: ["), rec, F.lit("]."))).otherwise(F.lit('[{"findingId":5}]'))
    d = responses.ingest_verdicts(f.select("run_id", "ord", raw.alias("raw")), ["run_id", "ord"])
    return d.select("run_id", "ord", "finding_id", "passed", F.array_join("issues", ";").alias("issues"))


@query("profile_ingest", """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN CAST(doc_id % 50 AS INT) END AS line, CASE doc_id % 4 WHEN 2 THEN 'Validation errors:' || chr(10) || '- sources.0.type: Invalid' WHEN 3 THEN 'JSON parse error' END AS error FROM documents""")
def profile_ingest(spark, sf):
    i = F.col("doc_id")
    body = lambda kind: F.concat(F.lit('{"sources":[{"name":"n","line":'), (i % 50).cast("string"), F.lit(f',"type":"{kind}"}}],"sinks":[],"transforms":[],"exports":[]}}'))
    s = i % 4
    raw = (F.when(s == 0, F.concat(F.lit("I see {this}. "), body("db-query"))).when(s == 1, F.concat(F.lit("```json\n"), body("fhir-read"), F.lit("\n```")))
           .when(s == 2, body("magic")).otherwise(F.lit("no idea")))
    d = responses.ingest_profiles(spark_table(spark, sf, "documents").select("doc_id", raw.alias("raw")), ["doc_id"])
    return d.select("doc_id", F.col("profile.sources")[0]["line"].cast("int").alias("line"), "error")


@query("path_verdicts", """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN doc_id % 2 = 0 END AS is_leak, CASE WHEN doc_id % 3 = 2 THEN 'Validation errors' END AS error FROM documents""")
def path_verdicts(spark, sf):
    i = F.col("doc_id")
    body = lambda c: F.concat(F.lit('{"isLeak":'), F.when(i % 2 == 0, "true").otherwise("false"), F.lit(f',"confidence":"{c}","explanation":"e","baaRelevant":true}}'))
    raw = F.when(i % 3 == 0, body("high")).when(i % 3 == 1, F.concat(F.lit("ok "), body("low"), F.lit(" thanks"))).otherwise(body("sure"))
    d = responses.ingest_path_verdicts(spark_table(spark, sf, "documents").select("doc_id", raw.alias("raw")), ["doc_id"])
    return d.select("doc_id", F.col("verdict.isLeak").alias("is_leak"), "error")


@query("inference", f"{FX} SELECT run_id, ord, CASE WHEN {SEV} = 0 THEN NULL ELSE concat('seen ', length(summary)) END AS raw, CASE WHEN {SEV} = 0 THEN 'refused' END AS error FROM findings_fx")
def infer(spark, sf):
    def complete(system, user):
        if system == "CRITICAL":
            raise ValueError("refused")
        return f"seen {len(user)}"

    p = findings(spark, sf).select("run_id", "ord", F.col("severity").alias("system"), F.col("summary").alias("user"))
    return inference.infer(p, complete, ["run_id", "ord"]).drop("duration_ms")


@query("patch_extract", f"{FX} SELECT ord, concat('--- a', chr(10), '+++ b ', id) AS patch, CASE WHEN ord % 3 = 0 THEN concat('why ', id) ELSE 'Fix applied for the described issue.' END AS explanation FROM findings_fx")
def patch_extract(spark, sf):
    diff = F.concat(F.lit("--- a\n+++ b "), "id")
    s = F.col("ord") % 3
    raw = F.when(s == 0, F.concat(F.lit("```diff\n"), diff, F.lit("\n```\nexplanation: why "), "id")).when(s == 1, F.concat(F.lit("Patch:\n"), diff)).otherwise(diff)
    return findings(spark, sf).select("ord", text.extract_patch(raw).alias("patch"), text.extract_explanation(raw).alias("explanation"))


@query("lens_catalog", """SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'missing required string field: "name"' WHEN 2 THEN 'focusAreas must be an array' WHEN 3 THEN 'focusAreas must hold strings' WHEN 4 THEN 'system prompt exceeds 10240 bytes' WHEN 5 THEN 'must be a JSON object' END AS reason,
doc_id % 6 = 0 AS valid FROM documents""")
def lens_catalog(spark, sf):
    i = F.col("doc_id")
    s = i % 6
    body = F.concat(F.lit('{"id":"l'), i.cast("string"), F.lit('","description":"d",'), F.when(s == 1, "").otherwise('"name":"n",'),
                    F.lit('"systemPrompt":"'), F.when(s == 4, F.repeat(F.lit("p"), 10241)).otherwise("p"), F.lit('","focusAreas":'),
                    F.when(s == 2, '"x"').when(s == 3, "[1]").otherwise('["a"]'), F.lit("}"))
    raw = F.when(s == 5, "[1]").otherwise(body)
    return lenses.validate(spark_table(spark, sf, "documents").select("doc_id", raw.alias("raw"))).select("doc_id", "reason", "valid")


@query("unknown_lenses", "SELECT DISTINCT lang AS id FROM documents WHERE lang NOT IN ('en', 'fr')")
def unknown_lenses(spark, sf):
    d = spark_table(spark, sf, "documents").select(F.col("lang").alias("id"))
    return lenses.unknown_ids(d, d.filter("id in ('en', 'fr')"))


@query("lens_prompts", f"{FX} SELECT run_id, lens, md5(concat('## Changed Files', chr(10), 'n=', n, chr(10), chr(10), '## Diff', chr(10), 'd', run_id)) AS user_md5 FROM (SELECT run_id, count(*) AS n FROM findings_fx GROUP BY run_id) r JOIN (SELECT DISTINCT run_id, lens FROM findings_fx WHERE lens <> 'quality') l USING (run_id)")
def lens_prompts(spark, sf):
    f = findings(spark, sf)
    reviews = f.groupBy("run_id").agg(F.concat(F.lit("n="), F.count(F.lit(1)).cast("string")).alias("file_list")).withColumn("diff", F.concat(F.lit("d"), F.col("run_id").cast("string")))
    table = f.select(F.explode("lenses").alias("id")).distinct().withColumn("system_prompt", F.lit("p"))
    asked = f.select("run_id", F.explode("lenses").alias("lens")).filter("lens <> 'quality'")
    return packing.lens_prompts(reviews, table, asked).select("run_id", "lens", F.md5("user").alias("user_md5"))


# -- review diffs --------------------------------------------------------------------
# Every changed file has a section in the diff of its run, but for a few.
SECTION = "concat('diff --git a/old/', filename, ' b/', filename, chr(10), repeat(concat('+', filename, chr(10)), CAST(changes AS INT)))"
REVIEW = f"""{FX}, {CHANGED_FX.replace("WHERE length(file) % 2 = 0 OR file LIKE '%1.ts' ", "")},
ch2 AS (SELECT *, CASE WHEN file_ord % 4 <> 0 THEN {SECTION} END AS sec FROM changed_fx)"""


def review(spark, sf):
    f = spark_fixture(spark, sf, "findings_fx")
    c = f.groupBy("run_id", F.col("file").alias("filename")).agg(
        F.min("ord").alias("file_ord"), F.max("line").alias("additions"), F.min("line").alias("deletions"), F.count(F.lit(1)).alias("changes")).withColumns(
        {"status": F.lit("modified"), "patch": F.when(F.col("file_ord") % 5 != 0, F.concat(F.lit("@@ "), "filename"))})
    body = F.concat(F.lit("diff --git a/old/"), "filename", F.lit(" b/"), "filename", F.lit("\n"),
                    F.repeat(F.concat(F.lit("+"), "filename", F.lit("\n")), F.col("changes").cast("int")))
    sections = c.filter("file_ord % 4 <> 0").select("run_id", "file_ord", body.alias("b"))
    # A fixture only: the test diffs are small, so one text per run is built.
    diffs = sections.groupBy("run_id").agg(F.concat(F.lit("preamble\n"), F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("file_ord", "b"))), lambda x: x["b"]), "")).alias("diff"))
    return c, diffs


@query("diff_sections", f"{REVIEW} SELECT run_id, filename, md5(sec) AS section FROM ch2 WHERE sec IS NOT NULL AND NOT regexp_matches(filename, '^src/m1[^/]*\\.ts$') UNION ALL SELECT DISTINCT run_id, NULL, md5('preamble' || chr(10)) FROM ch2 WHERE sec IS NOT NULL")
def diff_sections(spark, sf):
    c, diffs = review(spark, sf)
    kept = packing.drop_ignored(c, ["src/m1*.ts", "**/none/*"])
    return packing.keep_sections(packing.diff_sections(diffs), kept).select("run_id", "filename", F.md5("section").alias("section"))


CONTEXT = 4600


@query("diff_packing", f"""{REVIEW}, sz AS (SELECT *, CAST(ceil((length(sec) - 1) / 4) AS BIGINT) AS t, sec IS NULL AND patch IS NULL AS skip FROM ch2),
rm AS (SELECT run_id, {CONTEXT} - 4000 - ceil((sum(length(concat('- ', filename, ' (modified, +', additions, '/-', deletions, ')')) + 1) - 1) / 4) AS room FROM ch2 GROUP BY run_id),
od AS (SELECT s.*, room, row_number() OVER (PARTITION BY s.run_id ORDER BY s.changes, s.file_ord) AS rn FROM sz s JOIN rm USING (run_id) WHERE sec IS NOT NULL),
fo AS (SELECT run_id, rn, filename, CASE WHEN t <= room THEN t ELSE 0 END AS used, t <= room AS took FROM od WHERE rn = 1
 UNION ALL SELECT od.run_id, od.rn, od.filename, fo.used + CASE WHEN fo.used + od.t <= od.room THEN od.t ELSE 0 END, fo.used + od.t <= od.room FROM fo JOIN od ON od.run_id = fo.run_id AND od.rn = fo.rn + 1)
SELECT sz.run_id, sz.filename, sz.t AS tokens, CASE WHEN skip THEN 'skipped' WHEN took THEN 'packed' ELSE 'summary' END AS fate FROM sz LEFT JOIN fo USING (run_id, filename)""")
def diff_packing(spark, sf):
    c, diffs = review(spark, sf)
    d = packing.attach_sections(c, packing.diff_sections(diffs))
    return packing.pack_diff(d, CONTEXT).select("run_id", "filename", "tokens", "fate")


NOTES = "nt AS (SELECT repo, doc_id AS ord, 'warn' AS level, concat('note ', CAST(doc_id % 3 AS VARCHAR)) AS message FROM files_fx WHERE doc_id % 11 = 0)"
CTX = 400


@query("repo_context", f"""{with_fixtures('files_fx')}, {NOTES}, im AS (SELECT repo, 1 AS section, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS no, concat('- ', path, ' → lib', doc_id % 7, ' (external)', ' (symbols: a, b)') AS line FROM files_fx),
tr AS (SELECT repo, 2 AS section, row_number() OVER (PARTITION BY repo ORDER BY path) AS no, concat('- ', path, ' (', printf('%.1f', size / 1024), 'KB)') AS line FROM files_fx),
dg AS (SELECT repo, 3 AS section, row_number() OVER (PARTITION BY repo ORDER BY ord) AS no, concat('- [WARN] ', message) AS line FROM nt),
al AS (SELECT * FROM im WHERE no <= 200 UNION ALL SELECT * FROM tr WHERE no <= 100 UNION ALL SELECT * FROM dg),
cs AS (SELECT *, CASE section WHEN 1 THEN 22 WHEN 2 THEN 23 ELSE 14 END AS hd FROM al),
rn AS (SELECT *, ceil(hd / 4) + sum(ceil((length(line) + 1) / 4)) OVER w AS run, hd + sum(length(line) + 1) OVER w AS chars, ceil((hd + sum(length(line) + 1) OVER (PARTITION BY repo, section)) / 4) AS full_ FROM cs WINDOW w AS (PARTITION BY repo, section ORDER BY no)),
s1 AS (SELECT * FROM rn WHERE section = 1 AND (full_ <= {CTX} OR run <= {CTX})), u1 AS (SELECT f.repo, coalesce(ceil(max(s1.chars) / 4), 0) AS u FROM (SELECT DISTINCT repo FROM al) f LEFT JOIN s1 USING (repo) GROUP BY f.repo),
s2 AS (SELECT rn.* FROM rn JOIN u1 USING (repo) WHERE section = 2 AND u < {CTX} AND (u + full_ <= {CTX} OR u + run <= {CTX})), u2 AS (SELECT u1.repo, any_value(u) + coalesce(ceil(max(s2.chars) / 4), 0) AS u FROM u1 LEFT JOIN s2 USING (repo) GROUP BY u1.repo),
s3 AS (SELECT rn.* FROM rn JOIN u2 USING (repo) WHERE section = 3 AND u < {CTX} AND (u + full_ <= {CTX} OR u + run <= {CTX}))
SELECT repo, section, no, line FROM s1 UNION ALL SELECT repo, section, no, line FROM s2 UNION ALL SELECT repo, section, no, line FROM s3""")
def repo_context(spark, sf):
    f = files(spark, sf)
    edges = f.select("repo", F.col("doc_id").alias("ord"), F.col("path").alias("src"), F.concat(F.lit("lib"), (F.col("doc_id") % 7).cast("string")).alias("dst"),
                     F.array(F.lit("a"), F.lit("b")).alias("symbols"), F.lit(True).alias("external"))
    notes = f.filter("doc_id % 11 = 0").select("repo", F.col("doc_id").alias("ord"), F.lit("warn").alias("level"), F.concat(F.lit("note "), (F.col("doc_id") % 3).cast("string")).alias("message"))
    return packing.fit_context(packing.context_lines(edges, f.select("repo", "path", "size"), notes), CTX)


@query("baseline_roundtrip", f"""{FX} SELECT CAST(run_id AS VARCHAR) AS target, count(*) AS entries, count(DISTINCT {FP}) AS fingerprints FROM findings_fx GROUP BY run_id""")
def baseline_roundtrip(spark, sf):
    path = os.path.join(scratch_dir(spark, "baseline"), "table")
    rows = baseline.snapshot(findings(spark, sf).withColumn("target", F.col("run_id").cast("string")), "2024-01-01 00:00:00")
    baseline.write(rows, path)
    baseline.write(rows.filter("target = '3'"), path)  # one target again; the others stay
    return baseline.read(spark, path).groupBy("target").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("fingerprint").alias("fingerprints"))
