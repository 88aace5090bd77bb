"""Driver queries over findings, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.functions import severity as sev
from codewarden.functions import text
from codewarden.operators import findings as fi
from codewarden.operators import merge
from codewarden.session import cut_lineage
from codewarden.sources import baseline as bl
from codewarden.sources import exports

from .fixtures import spark_fixture, spark_sql, with_fixtures

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def findings(spark, sf):
    d = spark_fixture(spark, sf, "findings_fx")
    return d.withColumn("lenses", F.array("lens")).drop("lens", "file", "line")


def gated(spark, sf):
    return findings(spark, sf).withColumn("disposition", fi.disposition(F.col("score"), F.col("deterministic"), 50))


FX = with_fixtures("findings_fx")
SEV = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
NORM = r"regexp_replace(regexp_replace(trim(lower(summary)), '\s+', ' ', 'g'), '[^\w\s]', '', 'g')"
DISP = """CASE WHEN deterministic THEN 'confirmed' WHEN score IS NULL THEN 'unvalidated' WHEN score < 50 OR score < 40 THEN 'disproven'
 WHEN score < 60 THEN 'uncertain' ELSE 'confirmed' END"""
# Other findings of a run are needed whole here: results of every lens.
RESULTS_FX = """results_fx AS (
  SELECT run_id, lens, CASE WHEN (run_id * 5 + i) % 7 = 0 THEN 'timeout' END AS error, (run_id * 5 + i) % 7 = 1 AS parse_error
  FROM (SELECT DISTINCT run_id FROM findings_fx) r
  CROSS JOIN (SELECT 0 AS i, 'security' AS lens UNION ALL SELECT 1, 'architecture' UNION ALL SELECT 2, 'quality'
              UNION ALL SELECT 3, 'hipaa' UNION ALL SELECT 4, 'soc2') l)"""


def results(spark, f):
    lenses = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("lens")) for i, n in enumerate(
        ["security", "architecture", "quality", "hipaa", "soc2"])])
    d = f.select("run_id").distinct().withColumn("l", F.explode(lenses))
    slot = (F.col("run_id") * 5 + F.col("l.i")) % 7
    return d.select("run_id", F.col("l.lens").alias("lens"), F.when(slot == 0, "timeout").alias("error"), (slot == 1).alias("parse_error"))


# Changed files of a run: every third module, with a patch for most.
CHANGED_FX = """changed_fx AS (
  SELECT run_id, file AS filename, min(ord) AS file_ord, max(line) AS additions, min(line) AS deletions, count(*) AS changes, 'modified' AS status,
         CASE WHEN min(ord) % 5 <> 0 THEN concat('@@ ', file, ' ', repeat('+x', CAST(count(*) * 40 AS INT))) END AS patch
  FROM findings_fx WHERE length(file) % 2 = 0 OR file LIKE '%1.ts' GROUP BY run_id, file)"""


def changed(spark, sf):
    from .fixtures import FIXTURES, _escape_braces

    sql = f"WITH findings_fx AS ({FIXTURES['findings_fx']}), {CHANGED_FX} SELECT * FROM changed_fx"
    return spark_sql(spark, sf, _escape_braces(sql))


@query("exact_merge", f"""{FX}, n AS (SELECT *, lower(trim(split_part(location, ':', 1))) AS fk, {NORM} AS sk FROM findings_fx),
l AS (SELECT run_id, fk, severity, sk, lens, min(ord) AS o FROM n GROUP BY ALL),
ll AS (SELECT run_id, fk, severity, sk, string_agg(lens, ',' ORDER BY o) AS lenses FROM l GROUP BY ALL)
SELECT n.run_id, n.severity, min(n.ord) AS ord, arg_min(n.location, n.ord) AS location, count(*) AS copies, max(length(detail)) AS detail_len, ll.lenses
FROM n JOIN ll USING (run_id, fk, severity, sk) GROUP BY n.run_id, n.fk, n.severity, n.sk, ll.lenses""")
def exact_merge(spark, sf):
    return fi.merge_exact(findings(spark, sf), ["run_id"]).select(
        "run_id", "severity", "ord", "location", "copies", F.length("detail").alias("detail_len"), F.array_join("lenses", ",").alias("lenses"))


@query("severity_counts", f"""{FX} SELECT run_id, count(*) AS total, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in sev.SEVERITIES)}
FROM findings_fx GROUP BY run_id""")
def severity_counts(spark, sf):
    return fi.severity_counts(findings(spark, sf))


@query("lens_counts", f"{FX} SELECT run_id, lens, count(*) AS findings FROM findings_fx GROUP BY run_id, lens")
def lens_counts(spark, sf):
    return fi.lens_counts(findings(spark, sf))


@query("lens_status", f"""{FX}, {RESULTS_FX}, c AS (SELECT run_id, lens, count(*) AS n FROM findings_fx GROUP BY ALL),
conf AS (SELECT run_id, CASE WHEN bool_or(error IS NOT NULL OR parse_error) THEN 'LOW' ELSE 'NORMAL' END AS confidence FROM results_fx GROUP BY run_id)
SELECT r.run_id, r.lens, CASE WHEN error IS NOT NULL THEN 'errored' WHEN parse_error THEN 'parse_error' WHEN n IS NULL THEN 'clean' ELSE 'findings' END AS status,
confidence FROM results_fx r LEFT JOIN c USING (run_id, lens) JOIN conf USING (run_id)""")
def lens_status(spark, sf):
    f = findings(spark, sf)
    r = results(spark, f)
    return fi.lens_status(r, f).join(fi.review_confidence(r), "run_id")


@query("validation_counts", f"""{FX}, d AS (SELECT *, {DISP} AS disposition FROM findings_fx)
SELECT run_id, count(*) FILTER (disposition = 'confirmed') AS confirmed, count(*) FILTER (disposition = 'uncertain') AS uncertain,
count(*) FILTER (disposition = 'disproven') AS disproven, count(*) FILTER (disposition = 'unvalidated') AS unvalidated,
count(*) FILTER (disposition = 'disproven') AS filtered FROM d GROUP BY run_id""")
def validation_counts(spark, sf):
    return fi.validation_counts(gated(spark, sf))


@query("visible_findings", f"""{FX}, d AS (SELECT *, {DISP} AS disposition FROM findings_fx)
SELECT run_id, id, disposition FROM d WHERE disposition IS DISTINCT FROM 'disproven'""")
def visible_findings(spark, sf):
    return fi.visible(gated(spark, sf)).select("run_id", "id", "disposition")


@query("severity_gate", f"{FX} SELECT location, bool_or({SEV} <= 1) AS failed FROM findings_fx GROUP BY location")
def severity_gate(spark, sf):
    return fi.severity_gate(findings(spark, sf), "HIGH", "location")


@query("fixable_findings", f"""{FX}, d AS (SELECT *, {DISP} AS disposition FROM findings_fx)
SELECT run_id, id, severity, score FROM d WHERE severity IN ('CRITICAL','HIGH','MEDIUM') AND disposition <> 'disproven' AND (score IS NULL OR score >= 70)""")
def fixable_findings(spark, sf):
    return fi.fixable(gated(spark, sf), 70).select("run_id", "id", "severity", "score")


FP = "sha256(concat_ws('||', trim(split_part(location, ':', 1)), lower(trim(category)), left(trim(lower(summary)), 100)))"


@query("baseline_split", f"""{FX}, f AS (SELECT *, {FP} AS fp FROM findings_fx), known AS (SELECT DISTINCT run_id, fp FROM f WHERE ord % 4 = 0)
SELECT f.run_id, f.ord, f.fp AS fingerprint, known.fp IS NOT NULL AS suppressed FROM f LEFT JOIN known ON f.run_id = known.run_id AND f.fp = known.fp""")
def baseline_split(spark, sf):
    f = fi.with_fingerprint(findings(spark, sf))
    return fi.split_baseline(f, f.filter("ord % 4 = 0"), ["run_id", "fingerprint"]).select("run_id", "ord", "fingerprint", "suppressed")


@query("baseline_snapshot", f"""{FX} SELECT CAST(run_id AS VARCHAR) AS target, {FP} AS fingerprint, severity, location, summary,
TIMESTAMP '2024-01-01 00:00:00' AS suppressed_at FROM findings_fx""")
def baseline_snapshot(spark, sf):
    rows = bl.snapshot(findings(spark, sf).withColumn("target", F.col("run_id").cast("string")), "2024-01-01 00:00:00")
    back = bl.from_json(bl.to_json(rows))
    return back.withColumn("suppressed_at", F.col("suppressed_at").cast("timestamp_ntz"))


@query("score_attach", f"""{FX}, s AS (SELECT run_id, concat('f-', CAST(ord - ord % 3 AS VARCHAR)) AS id, ord AS seq, score FROM findings_fx),
l AS (SELECT run_id, id, arg_max(score, seq) AS score FROM s GROUP BY run_id, id)
SELECT f.run_id, f.id, l.score FROM findings_fx f LEFT JOIN l USING (run_id, id)""")
def score_attach(spark, sf):
    f = findings(spark, sf)
    s = f.select("run_id", F.concat(F.lit("f-"), (F.col("ord") - F.col("ord") % 3).cast("string")).alias("id"), F.col("ord").alias("seq"), "score")
    return fi.attach_scores(f.drop("score"), s, ["run_id", "id"]).select("run_id", "id", "score")


@query("verdict_attach", f"""{FX}, v AS (SELECT run_id, id, score > 50 AS passed FROM findings_fx WHERE ord % 3 <> 0)
SELECT f.run_id, f.id, coalesce(v.passed, false) AS passed, CASE WHEN v.passed IS NULL THEN 'Verification response missing for this fix' ELSE '' END AS issues
FROM findings_fx f LEFT JOIN v USING (run_id, id)""")
def verdict_attach(spark, sf):
    f = findings(spark, sf)
    v = f.filter("ord % 3 <> 0").select("run_id", "id", F.col("ord").alias("seq"), (F.col("score") > 50).alias("passed"),
                                       F.array().cast("array<string>").alias("issues"))
    return fi.attach_verdicts(f.select("run_id", "id"), v, ["run_id", "id"]).withColumn("issues", F.array_join("issues", ";"))


@query("inline_comments", f"""{FX}, {CHANGED_FX} SELECT f.run_id, f.id, f.file AS path, f.line, c.filename IS NOT NULL AS inline,
CASE WHEN c.filename IS NOT NULL THEN concat('**', CASE severity WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' WHEN 'LOW' THEN '🔵' ELSE '⚪' END,
' ', severity, ' — ', category, '**', chr(10), '> ', summary, chr(10), chr(10), detail, chr(10), chr(10), '**Suggestion:** ', suggestion, chr(10), chr(10),
'*codewarden [', lens, ']*') END AS body
FROM findings_fx f LEFT JOIN changed_fx c ON f.run_id = c.run_id AND f.file = c.filename""")
def inline_comments(spark, sf):
    return fi.map_inline(findings(spark, sf), changed(spark, sf)).select("run_id", "id", "path", "line", "inline", "body")


@query("finding_patches", f"""{FX}, {CHANGED_FX}, a AS (SELECT DISTINCT run_id, substr(file, 5) AS tail FROM findings_fx),
b AS (SELECT a.run_id, a.tail, arg_min(coalesce(patch, ''), file_ord) AS patch FROM a JOIN changed_fx c ON a.run_id = c.run_id
  AND (c.filename = a.tail OR ends_with(c.filename, a.tail)) GROUP BY a.run_id, a.tail)
SELECT f.run_id, f.id, length(coalesce(b.patch, '')) AS patch_len FROM findings_fx f LEFT JOIN b ON f.run_id = b.run_id AND substr(f.file, 5) = b.tail""")
def finding_patches(spark, sf):
    f = findings(spark, sf).withColumn("location", F.substring("location", 5, 1000))
    return fi.attach_patch(f, changed(spark, sf), take={"patch_len": F.length}).select("run_id", "id", "patch_len")


@query("score_batches", f"""{FX}, {CHANGED_FX}, b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1) / 10) AS BIGINT) AS batch FROM findings_fx),
p AS (SELECT DISTINCT b.run_id, b.batch, c.file_ord, concat('diff for ', c.filename, chr(10), c.patch) AS t FROM b JOIN changed_fx c ON b.run_id = c.run_id AND b.file = c.filename WHERE patch <> ''),
e AS (SELECT run_id, batch, string_agg(t, chr(10) || chr(10) ORDER BY file_ord) AS parts FROM p GROUP BY ALL)
SELECT run_id, batch, length(x) AS evidence_len, left(x, 60) AS head, right(x, 30) AS tail FROM (
SELECT b.run_id, b.batch, CASE WHEN length(coalesce(parts, d.diff)) > 7000 THEN concat(left(coalesce(parts, d.diff), 7000), chr(10), '...[truncated for validation]') ELSE coalesce(parts, d.diff) END AS x
FROM (SELECT DISTINCT run_id, batch FROM b) b LEFT JOIN e USING (run_id, batch) JOIN (SELECT DISTINCT run_id, concat('whole diff of run ', CAST(run_id AS VARCHAR)) AS diff FROM findings_fx) d USING (run_id)) q""")
def score_batches(spark, sf):
    f = findings(spark, sf)
    batched = fi.batch_number(f.select("run_id", "ord", "location"), ["run_id"], [F.col("ord")], fi.SCORE_BATCH)
    diffs = f.select("run_id", F.concat(F.lit("whole diff of run "), F.col("run_id").cast("string")).alias("diff")).distinct()
    return fi.batch_evidence(batched, changed(spark, sf), diffs, take={
        "evidence_len": F.length, "head": lambda e: F.left(e, F.lit(60)), "tail": lambda e: F.right(e, F.lit(30))})


# The merges as recursive queries: the state of a file after n rows is its list of
# groups; row n + 1 goes to the first group that accepts it, or opens a new one.
JACCARD = "len(list_intersect(y.w, i.w)) / len(list_distinct(list_concat(y.w, i.w)))"
RANKED = "CASE rank WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END"


@query("review_merge", f"""{FX}, n AS (SELECT *, {SEV} AS rank, {NORM} AS sk FROM findings_fx),
x AS (SELECT run_id, file, rank, sk, min(ord) AS ord, arg_min(id, ord) AS id, max(length(detail)) AS dl FROM n GROUP BY ALL),
xl AS (SELECT run_id, file, rank, sk, lens, min(ord) AS lo FROM n GROUP BY ALL),
it AS (SELECT *, list_distinct(string_split(sk, ' ')) AS w, row_number() OVER (PARTITION BY run_id, file ORDER BY ord) AS n FROM x),
g(run_id, file, n, ord, anchor, st) AS (
  SELECT run_id, file, n, ord, ord, [{{'o': ord, 'r': rank, 'w': w}}] FROM it WHERE n = 1
  UNION ALL
  SELECT run_id, file, n, ord, CASE WHEN p > 0 THEN st[p].o ELSE ord END,
         CASE WHEN p > 0 THEN list_transform(st, lambda y, k: CASE WHEN k = p THEN {{'o': y.o, 'r': least(y.r, rank), 'w': y.w}} ELSE y END)
              ELSE list_append(st, {{'o': ord, 'r': rank, 'w': w}}) END
  FROM (SELECT i.*, g.st, coalesce(list_position(list_transform(g.st, lambda y: abs(y.r - i.rank) <= 1 AND {JACCARD} > 0.8), true), 0) AS p
        FROM g JOIN it i ON i.run_id = g.run_id AND i.file = g.file AND i.n = g.n + 1) q),
l AS (SELECT g.run_id, g.file, g.anchor, xl.lens, min({{'a': g.ord, 'b': lo}}) AS o FROM g JOIN x USING (run_id, file, ord) JOIN xl USING (run_id, file, rank, sk) GROUP BY ALL),
ll AS (SELECT run_id, file, anchor, string_agg(lens, ',' ORDER BY o) AS lenses FROM l GROUP BY ALL),
m AS (SELECT g.run_id, g.file, g.anchor, arg_min(x.id, x.ord) AS id, min(x.rank) AS rank, max(x.dl) AS detail_len, count(*) AS merged_from
      FROM g JOIN x USING (run_id, file, ord) GROUP BY ALL)
SELECT run_id, id, {RANKED} AS severity, detail_len, lenses, merged_from FROM m JOIN ll USING (run_id, file, anchor)""")
def review_merge(spark, sf):
    return merge.review_dedup(findings(spark, sf), ["run_id"]).select(
        "run_id", "id", "severity", F.length("detail").alias("detail_len"), F.array_join("lenses", ",").alias("lenses"), "merged_from")


@query("scan_merge", f"""{FX}, p1 AS (SELECT *, {SEV} AS rank, row_number() OVER (PARTITION BY run_id, file, category ORDER BY ord) AS n FROM findings_fx),
a1(run_id, file, category, n, ord, anchor, took, st) AS (
  SELECT run_id, file, category, n, ord, ord, false, [{{'o': ord, 'l': line, 'd': deterministic}}] FROM p1 WHERE n = 1
  UNION ALL
  SELECT run_id, file, category, n, ord, CASE WHEN p > 0 THEN st[p].o ELSE ord END, p > 0 AND deterministic AND NOT st[p].d,
         CASE WHEN p = 0 THEN list_append(st, {{'o': ord, 'l': line, 'd': deterministic}})
              WHEN deterministic AND NOT st[p].d THEN list_transform(st, lambda y, k: CASE WHEN k = p THEN {{'o': y.o, 'l': line, 'd': true}} ELSE y END) ELSE st END
  FROM (SELECT i.*, a.st, coalesce(list_position(list_transform(a.st, lambda y: abs(y.l - i.line) <= 5), true), 0) AS p
        FROM a1 a JOIN p1 i ON i.run_id = a.run_id AND i.file = a.file AND i.category = a.category AND i.n = a.n + 1) q),
b1 AS (SELECT a.anchor, CASE WHEN a.took THEN -f.ord ELSE f.ord END AS seq, a.took, f.*, {SEV} AS rank FROM a1 a JOIN findings_fx f USING (ord)),
l1 AS (SELECT run_id, file, category, anchor, lens, min(seq) AS o FROM b1 GROUP BY ALL),
m1 AS (SELECT run_id, file, category, anchor, arg_min(id, seq) AS id, arg_min(ord, seq) AS ord, arg_min(summary, seq) AS summary, min(rank) AS rank,
       max(length(detail)) AS dl, arg_max(suggestion, length(suggestion)) AS suggestion, bool_or(deterministic) AS det,
       CASE WHEN bool_or(deterministic) AND count(*) > 1 THEN 100 ELSE arg_min(score, seq) END AS score FROM b1 GROUP BY ALL),
p2 AS (SELECT m1.*, ls, list_distinct(string_split(lower(summary), ' ')) AS w, row_number() OVER (PARTITION BY run_id, file ORDER BY ord) AS n
       FROM m1 JOIN (SELECT run_id, file, category, anchor, list(lens ORDER BY o) AS ls FROM l1 GROUP BY ALL) USING (run_id, file, category, anchor)),
a2(run_id, file, n, ord, anchor, took, st) AS (
  SELECT run_id, file, n, ord, ord, false, [{{'o': ord, 's': list_sort(ls), 'w': w, 'd': det}}] FROM p2 WHERE n = 1
  UNION ALL
  SELECT run_id, file, n, ord, CASE WHEN p > 0 THEN st[p].o ELSE ord END, p > 0 AND det AND NOT st[p].d,
         CASE WHEN p = 0 THEN list_append(st, {{'o': ord, 's': list_sort(ls), 'w': w, 'd': det}})
              ELSE list_transform(st, lambda y, k: CASE WHEN k <> p THEN y ELSE {{'o': y.o, 's': list_sort(list_distinct(list_concat(y.s, ls))),
                'w': CASE WHEN det AND NOT y.d THEN w ELSE y.w END, 'd': y.d OR det}} END) END
  FROM (SELECT i.*, a.st, coalesce(list_position(list_transform(a.st, lambda y: y.s <> list_sort(i.ls) AND {JACCARD} >= 0.5), true), 0) AS p
        FROM a2 a JOIN p2 i ON i.run_id = a.run_id AND i.file = a.file AND i.n = a.n + 1) q),
b2 AS (SELECT a.anchor AS anchor2, CASE WHEN a.took THEN -p2.ord ELSE p2.ord END AS seq, p2.* FROM a2 a JOIN p2 USING (run_id, file, ord)),
u2 AS (SELECT run_id, file, anchor2, seq, unnest(ls) AS lens, unnest(range(len(ls))) AS i FROM b2),
l2 AS (SELECT run_id, file, anchor2, lens, min({{'a': seq, 'b': i}}) AS o FROM u2 GROUP BY ALL),
ll AS (SELECT run_id, file, anchor2, string_agg(lens, ',' ORDER BY o) AS lenses FROM l2 GROUP BY ALL),
m2 AS (SELECT run_id, file, anchor2, arg_min(id, seq) AS id, min(rank) AS rank, max(dl) AS detail_len, arg_max(suggestion, length(suggestion)) AS suggestion,
       CASE WHEN bool_or(det) AND count(*) > 1 THEN 100 ELSE arg_min(score, seq) END AS score, count(*) AS merged_from FROM b2 GROUP BY ALL)
SELECT run_id, id, {RANKED} AS severity, score, detail_len, suggestion, lenses, merged_from FROM m2 JOIN ll USING (run_id, file, anchor2)""")
def scan_merge(spark, sf):
    return merge.scan_dedup(findings(spark, sf), ["run_id"]).select(
        "run_id", "id", "severity", "score", F.length("detail").alias("detail_len"), "suggestion", F.array_join("lenses", ",").alias("lenses"), "merged_from")


@query("line_islands", f"""{FX}, l AS (SELECT DISTINCT run_id, file, category, line FROM findings_fx),
s AS (SELECT *, CASE WHEN line - lag(line) OVER w <= 5 THEN 0 ELSE 1 END AS brk FROM l WINDOW w AS (PARTITION BY run_id, file, category ORDER BY line)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY run_id, file, category ORDER BY line) AS island FROM s)
SELECT f.run_id, f.file AS file_key, f.category, i.island, count(*) AS members, min(f.line) AS first_line, max(f.line) AS last_line
FROM findings_fx f JOIN i USING (run_id, file, category, line) GROUP BY ALL""")
def line_islands(spark, sf):
    return merge.line_islands(findings(spark, sf), ["run_id"]).groupBy("run_id", "file_key", "category", "island").agg(
        F.count(F.lit(1)).alias("members"), F.min("line_key").alias("first_line"), F.max("line_key").alias("last_line"))


VOTE = f"""{FX}, n AS (SELECT *, {SEV} AS rank, list_distinct(string_split(lower(summary), ' ')) AS w FROM findings_fx),
c AS (SELECT run_id, file, rank, array_to_string(list_sort(w), ' ') AS k, any_value(w) AS w FROM n GROUP BY 1, 2, 3, 4),
e AS (SELECT a.run_id, a.file, a.rank AS r1, a.k AS k1, b.rank AS r2, b.k AS k2 FROM c a JOIN c b ON a.run_id = b.run_id AND a.file = b.file AND abs(a.rank - b.rank) <= 1
  AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.7),
r AS (SELECT run_id, file, r1, k1, r2, k2 FROM e UNION SELECT r.run_id, r.file, r.r1, r.k1, e.r2, e.k2 FROM r JOIN e ON r.run_id = e.run_id AND r.file = e.file AND r.r2 = e.r1 AND r.k2 = e.k1),
g AS (SELECT run_id, file, r1, k1, min(concat(r2, k2)) AS comp FROM r GROUP BY 1, 2, 3, 4),
m AS (SELECT n.*, g.comp FROM n JOIN g ON n.run_id = g.run_id AND n.file = g.file AND n.rank = g.r1 AND array_to_string(list_sort(n.w), ' ') = g.k1),
v AS (SELECT run_id, file, comp, arg_max(id, length(detail) * 10000000000 - ord) AS id, min(rank) AS rank, count(DISTINCT model) AS agreement,
  string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(*) AS merged_from, min(ord) AS first_ord FROM m GROUP BY 1, 2, 3)"""


def voted(spark, sf):
    return merge.vote(findings(spark, sf), ["run_id"])


@query("model_vote", f"""{VOTE} SELECT run_id, id, rank, agreement, models, merged_from, first_ord FROM v""")
def model_vote(spark, sf):
    return voted(spark, sf).select("run_id", "id", sev.rank(F.col("severity")).alias("rank"), "agreement",
                                   F.array_join("models", ",").alias("models"), "merged_from", "first_ord")


@query("vote_counts", f"""{VOTE}, q AS (SELECT run_id, count(*) AS merged, count(*) FILTER (agreement = 3) AS unanimous, count(*) FILTER (agreement > 1 AND agreement < 3) AS majority,
count(*) FILTER (agreement = 1) AS single FROM v GROUP BY run_id) SELECT q.*, raw FROM q JOIN (SELECT run_id, count(*) AS raw FROM findings_fx GROUP BY run_id) USING (run_id)""")
def vote_counts(spark, sf):
    return fi.vote_counts(voted(spark, sf), findings(spark, sf), 3)


@query("vote_strategies", f"""{VOTE}, t AS (SELECT * FROM v) SELECT 'majority' AS strategy, run_id, id, agreement FROM t WHERE agreement * 2 > 3 UNION ALL SELECT 'unanimous', run_id, id, agreement FROM t WHERE agreement = 3
UNION ALL SELECT 'any', run_id, id, agreement FROM t""")
def vote_strategies(spark, sf):
    v = cut_lineage(voted(spark, sf).select("run_id", "id", "agreement"))
    parts = [merge.by_strategy(v, s, 3).select(F.lit(s).alias("strategy"), "run_id", "id", "agreement") for s in ("majority", "unanimous", "any")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("hotspots", f"""{FX}, h AS (SELECT run_id, location, sum(CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS score,
count(*) AS total, min(ord) AS o, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in sev.SEVERITIES)} FROM findings_fx GROUP BY run_id, location),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, total DESC, o) AS rn FROM h) SELECT * EXCLUDE (o) FROM r WHERE rn <= 10""")
def hotspots(spark, sf):
    return fi.hotspots(findings(spark, sf))


@query("report_order", f"""{FX} SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY {SEV}, CASE lens WHEN 'security' THEN 0 WHEN 'architecture' THEN 1 ELSE 2 END,
regexp_extract(location, 'm([0-9]+)', 1) || '.', CAST(line AS VARCHAR), ord) AS pos FROM findings_fx""")
def report_order(spark, sf):
    from codewarden.operators.ordered import row_positions

    f = findings(spark, sf)
    return row_positions(f, ["run_id"], [*fi.report_order(), F.col("ord")], "pos").select("run_id", "id", "pos")


@query("scan_order", f"{FX} SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY {SEV}, ord) AS pos FROM findings_fx")
def scan_order(spark, sf):
    from codewarden.operators.ordered import row_positions

    return row_positions(findings(spark, sf), ["run_id"], fi.scan_order(), "pos").select("run_id", "id", "pos")


@query("vote_order", f"{VOTE} SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY agreement DESC, rank, first_ord) AS pos FROM v")
def vote_order(spark, sf):
    from codewarden.operators.ordered import row_positions

    v = voted(spark, sf).drop("ord").withColumnRenamed("first_ord", "ord")
    return row_positions(v, ["run_id"], fi.vote_order(), "pos").select("run_id", "id", "pos")


@query("fix_counts", f"""{FX}, s AS (SELECT run_id, CASE ord % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'reverted' WHEN 2 THEN 'failed' ELSE 'pending' END AS status FROM findings_fx)
SELECT run_id, count(*) AS eligible, count(*) FILTER (status <> 'failed') AS generated, count(*) FILTER (status = 'verified') AS verified,
count(*) FILTER (status = 'reverted') AS reverted, count(*) FILTER (status = 'failed') AS failed FROM s GROUP BY run_id""")
def fix_counts(spark, sf):
    status = F.element_at(F.array(*[F.lit(x) for x in ("verified", "reverted", "failed", "pending")]), (F.col("ord") % 4 + 1).cast("int"))
    return fi.fix_counts(findings(spark, sf).withColumn("status", status))


@query("union_tagged", f"""{FX} SELECT id, 'scan' AS origin, concat(lens, ',auth') AS lenses FROM findings_fx WHERE ord % 2 = 0
UNION ALL SELECT id, 'scan', CASE WHEN lens = 'security' THEN 'security' ELSE concat(lens, ',security') END FROM findings_fx WHERE ord % 2 = 1""")
def union_tagged(spark, sf):
    f = findings(spark, sf)
    both = fi.union_tagged({"auth": f.filter("ord % 2 = 0"), "security": f.filter("ord % 2 = 1")})
    return both.select("id", F.lit("scan").alias("origin"), F.array_join("lenses", ",").alias("lenses"))


@query("text_functions", f"""{FX} SELECT ord, CAST(ceil(length(detail) / 4) AS BIGINT) AS tokens, CAST(length(detail) * 0.4 AS DOUBLE) AS trace_tokens,
regexp_replace(regexp_replace(trim(lower(concat(summary, ' - a.b '))), '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g') AS summary_key,
regexp_replace(regexp_replace(trim(lower(concat(summary, ' - a.b '))), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g') AS summary_normal,
file AS location_normal, CASE WHEN line * 1000 < 60000 THEN concat(line, 's') ELSE concat(CAST(floor(line / 60) AS BIGINT), 'm ', line % 60, 's') END AS duration,
CASE {SEV} WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS escalated,
CASE WHEN {SEV} <= 1 THEN 'error' WHEN {SEV} = 2 THEN 'warning' ELSE 'note' END AS level
FROM findings_fx""")
def text_functions(spark, sf):
    s = F.concat(F.col("summary"), F.lit(" - a.b "))
    return findings(spark, sf).withColumn("line", text.inline_line(F.col("location"))).select(
        "ord", text.tokens(F.col("detail")).alias("tokens"), text.trace_tokens(F.length("detail")).alias("trace_tokens"),
        text.summary_key(s).alias("summary_key"), text.summary_normal(s).alias("summary_normal"),
        text.location_normal(F.replace(F.upper("location"), F.lit("/"), F.lit("\\"))).alias("location_normal"),
        text.duration(F.col("line") * 1000).alias("duration"), sev.escalate(F.col("severity")).alias("escalated"),
        sev.sarif_level(F.col("severity")).alias("level"))


@query("sarif_rules", f"""{FX}, x AS (SELECT *, concat('r-', CAST(ord % 50 AS VARCHAR)) AS rid FROM findings_fx)
SELECT run_id, rid AS rule_id, min(ord) AS ord, arg_min(summary, ord) AS summary, CASE arg_min(severity, ord) WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error'
WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level FROM x GROUP BY run_id, rid""")
def sarif_rules(spark, sf):
    f = findings(spark, sf).withColumn("id", F.concat(F.lit("r-"), (F.col("ord") % 50).cast("string")))
    rule = F.from_json("rule", "id string, shortDescription struct<text:string>, defaultConfiguration struct<level:string>")
    return exports.rules(f).withColumn("r", rule).select(
        "run_id", F.col("r.id").alias("rule_id"), "ord", F.col("r.shortDescription.text").alias("summary"), F.col("r.defaultConfiguration.level").alias("level"))


@query("sarif_log", f"""{FX} SELECT run_id, part, count(*) AS n_lines FROM (SELECT run_id, 1 AS part FROM findings_fx UNION ALL SELECT run_id, 3 FROM findings_fx
UNION ALL SELECT DISTINCT run_id, p FROM findings_fx CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 2 UNION ALL SELECT 4) q) z GROUP BY run_id, part""")
def sarif_log(spark, sf):
    return exports.sarif_lines(findings(spark, sf)).groupBy("run_id", "part").agg(F.count(F.lit(1)).alias("n_lines"))


@query("sarif_results", f"""{FX} SELECT run_id, ord, id AS rule_id, file AS uri, line AS start_line, CASE WHEN {SEV} <= 1 THEN 'error' WHEN {SEV} = 2 THEN 'warning' ELSE 'note' END AS level,
concat(summary, chr(10), chr(10), detail, chr(10), chr(10), 'Suggestion: ', suggestion) AS message FROM findings_fx""")
def sarif_results(spark, sf):
    kind = ("ruleId string, level string, message struct<text:string>, "
            "locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>")
    p = "r.locations[0].physicalLocation"
    return exports.results(findings(spark, sf)).withColumn("r", F.from_json("result", kind)).select(
        "run_id", "ord", F.col("r.ruleId").alias("rule_id"), F.expr(f"{p}.artifactLocation.uri").alias("uri"),
        F.expr(f"{p}.region.startLine").alias("start_line"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"))


@query("json_report", f"""{FX} SELECT run_id, id, severity, score FROM findings_fx""")
def json_report(spark, sf):
    rows = exports.json_rows(findings(spark, sf).select("run_id", "id", "severity", "score", "lenses"), "run_id")
    return rows.select("run_id", F.from_json("row", "id string, severity string, score int").alias("r")).select("run_id", "r.*")


# Runs without findings: three more runs than the findings know.
RUNS = "rn AS (SELECT DISTINCT run_id FROM findings_fx UNION SELECT run_id + 100 FROM findings_fx WHERE run_id < 3)"


@query("clean_runs", f"""{FX}, {RUNS} SELECT rn.run_id, count(f.ord) AS total, count(f.ord) FILTER (severity = 'CRITICAL') AS critical,
coalesce(bool_or({SEV} <= 1), false) AS failed FROM rn LEFT JOIN findings_fx f USING (run_id) GROUP BY rn.run_id""")
def clean_runs(spark, sf):
    f = findings(spark, sf)
    runs = f.select("run_id").distinct()
    runs = runs.unionByName(runs.filter("run_id < 3").select((F.col("run_id") + 100).alias("run_id")))
    counts = fi.severity_counts(f, runs=runs).select("run_id", "total", F.col("CRITICAL").alias("critical"))
    return counts.join(fi.severity_gate(f, "HIGH", runs=runs), "run_id")
