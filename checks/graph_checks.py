"""Driver queries over import and flow graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.functions import fixed, text
from codewarden.operators import flow, imports, runtime

from .files_checks import FX as FILES
from .files_checks import IMPORT_SQL, LANG, files
from .files_checks import ORACLES as FILE_SQL
from .fixtures import spark_fixture, spark_table, with_fixtures
from .values import BAA_COVERED, BAA_NONE, PHI_FIELDS

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


SOURCE_KINDS = ["db-query", "fhir-bulk", "hl7-v2", "file-read"]
SINK_KINDS = ["log", "external-api", "cache", "response"]


def _pick(i, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def _pick_sql(i, values):
    return f"CASE {i} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + " END"


def graph(spark, sf) -> flow.FlowGraph:
    e = spark_fixture(spark, sf, "edges_fx")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    edges = e.select("repo", name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"), F.array("symbol").alias("symbols"),
                     F.lit(False).alias("external"), (F.col("src") * 2 + F.col("slot")).alias("ord"))
    d = spark_table(spark, sf, "documents").select(F.lit("all").alias("repo"), "doc_id", name(F.col("doc_id")).alias("file"))
    i = F.col("doc_id")
    sources = d.filter(i % 50 == 0).select("repo", "file", F.concat(F.lit("src"), i.cast("string")).alias("name"), F.lit(1).alias("line"),
                                           _pick(i % 200 / 50, SOURCE_KINDS).alias("kind"), i.alias("ord"))
    sinks = d.filter(i % 20 == 7).select("repo", "file", F.concat(F.lit("log"), (i % 3).cast("string")).alias("name"), F.lit(2).alias("line"),
                                         _pick(F.floor(i / 20) % 4, SINK_KINDS).alias("kind"), i.alias("ord"))
    transforms = d.filter(i % 13 == 0).select("repo", "file", F.lit("s1").alias("name"), F.lit("s2").alias("input"))
    channel = F.when(i % 5 == 0, "<dynamic>").otherwise(F.concat(F.lit("c"), (i % 5).cast("string")))
    sides = F.concat(F.when(i % 97 == 1, F.array(F.lit("event-emit"))).otherwise(F.array().cast("array<string>")),
                     F.when(i % 89 == 2, F.array(F.lit("event-listen"))).otherwise(F.array().cast("array<string>")))
    flows = d.select("repo", F.col("file").alias("path"), F.explode(sides).alias("kind"), channel.alias("channel"),
                     F.lit("fn").alias("function_name"), F.lit(3).alias("line"), i.alias("ord"))
    return flow.FlowGraph(sources, sinks, edges, transforms, flows)


EX = with_fixtures("edges_fx")
CH = "CASE WHEN doc_id % 5 = 0 THEN '<dynamic>' ELSE concat('c', CAST(doc_id % 5 AS VARCHAR)) END"
PADS = "concat({k}, lpad(CAST({a} AS VARCHAR), 10, '0'), lpad(CAST({b} AS VARCHAR), 10, '0'))"
WALK = f"""{EX}, em AS (SELECT doc_id AS id, {CH} AS ch FROM documents WHERE doc_id % 97 = 1), li AS (SELECT doc_id AS id, {CH} AS ch FROM documents WHERE doc_id % 89 = 2),
mv AS (SELECT em.id AS a, li.id AS b, {PADS.format(k="'0'", a='em.id', b='li.id')} AS pick, concat('f', em.id, ':fn:3:event-emit') AS hop, false AS tr, em.ch = '<dynamic>' AS dy FROM em JOIN li ON em.ch = li.ch AND em.id <> li.id
 UNION ALL SELECT dst, src, {PADS.format(k="'1'", a='src * 2 + slot', b='0')}, concat('f', dst, ':', symbol, ':1:', CASE WHEN src % 13 = 0 AND symbol IN ('s1', 's2') THEN 'transform' ELSE 'import' END), src % 13 = 0 AND symbol IN ('s1', 's2'), false FROM edges_fx WHERE src <> dst
 UNION ALL SELECT src, dst, {PADS.format(k="'2'", a='src * 2 + slot', b='0')}, concat('f', src, ':', symbol, ':1:import-call'), false, false FROM edges_fx WHERE src <> dst),
wk AS (SELECT doc_id AS origin, doc_id AS node, 0 AS depth, '' AS picks, [doc_id] AS seen, '' AS hops, false AS tr, false AS dy FROM documents WHERE doc_id % 50 = 0
 UNION ALL SELECT wk.origin, mv.b, wk.depth + 1, concat(wk.picks, mv.pick), list_append(wk.seen, mv.b), concat(wk.hops, '>', mv.hop), wk.tr OR mv.tr, wk.dy OR mv.dy
 FROM wk JOIN mv ON wk.node = mv.a WHERE wk.depth < 5 AND NOT list_contains(wk.seen, mv.b)),
bs AS (SELECT origin, node, depth AS n_hops, hops, tr, dy, picks FROM (SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY depth, picks) AS rn FROM wk WHERE node % 20 = 7) q WHERE rn = 1)"""


@query("flow_reach", f"{WALK} SELECT concat('f', origin) AS origin, concat('f', node) AS node, n_hops, hops, tr AS transforms, dy AS dynamic FROM bs")
def flow_reach(spark, sf):
    g = graph(spark, sf)
    hop = lambda h: F.concat(F.lit(">"), h["file"], F.lit(":"), h["name"], F.lit(":"), h["line"].cast("string"), F.lit(":"), h["mechanism"])
    d = flow.reach(g).join(g.sinks.select("repo", F.col("file").alias("node")).distinct(), ["repo", "node"], "left_semi")
    return d.select("origin", "node", F.size("hops").alias("n_hops"), F.array_join(F.transform("hops", hop), "").alias("hops"), "transforms", "dynamic")


CONF = "CASE WHEN dy OR n_hops > 4 THEN 'low' WHEN tr OR n_hops >= 3 THEN 'medium' ELSE 'high' END"
RANKED = f"""{WALK}, pr AS (SELECT *, {_pick_sql('CAST(origin % 200 // 50 AS INT)', SOURCE_KINDS)} AS sk, {_pick_sql('CAST(node // 20 % 4 AS INT)', SINK_KINDS)} AS kk, {CONF} AS conf FROM bs),
rk AS (SELECT *, row_number() OVER (ORDER BY CASE kk WHEN 'external-api' THEN 13 WHEN 'log' THEN 9 WHEN 'response' THEN 7 ELSE 0 END DESC, n_hops,
 CASE sk WHEN 'fhir-bulk' THEN 11 WHEN 'hl7-v2' THEN 9 WHEN 'db-query' THEN 8 ELSE 1 END DESC, origin, picks, node) AS rank FROM pr),
fp AS (SELECT *, CASE WHEN conf = 'low' AND node % 3 = 2 THEN 'INFO' WHEN conf = 'high' AND kk = 'external-api' THEN 'CRITICAL' WHEN conf = 'high' THEN 'HIGH'
 WHEN conf = 'medium' AND sk IN ('fhir-bulk', 'hl7-v2') THEN 'HIGH' WHEN conf = 'medium' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM rk)"""
SAFE = [("log2", "expected-sink"), ("S4*", "sanitizer"), ("s5", "projection")]
ALL = None


@query("flow_paths", f"{RANKED} SELECT rank, concat('f', origin) AS source, sk AS source_kind, concat('f', node) AS sink, kk AS sink_kind, n_hops, conf AS confidence, severity FROM fp WHERE rank <= 20")
def flow_paths(spark, sf):
    p = flow.flow_paths(graph(spark, sf), safe=SAFE)
    return p.select("rank", F.col("source.file").alias("source"), F.col("source.kind").alias("source_kind"), F.col("sink.file").alias("sink"),
                    F.col("sink.kind").alias("sink_kind"), "n_hops", "confidence", "severity")


SAFER = f"""{RANKED}, sp AS (SELECT *, greatest(CASE conf WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END - len(regexp_extract_all(hops, ':s[45]:')), 0) AS lv,
 CASE WHEN node % 3 = 2 THEN 'INFO' ELSE severity END AS sev FROM fp)"""


def safer(spark, sf):
    return flow.apply_safe_patterns(flow.flow_paths(graph(spark, sf), k=ALL, safe=SAFE), SAFE)


@query("safe_patterns", f"{SAFER} SELECT rank, CASE lv WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, sev AS severity FROM sp")
def safe_patterns(spark, sf):
    return safer(spark, sf).select("rank", "confidence", "severity")


def verdicts(p):
    r = F.col("rank")
    ext = F.col("sink.kind") == "external-api"
    return p.withColumns({"is_leak": r % 3 != 0, "verdict_confidence": _pick(r % 3, ["low", "medium", "high"]), "explanation": F.lit("seen"),
                          "baa_relevant": ext, "baa": F.when(ext, _pick(r % 2, ["no-baa", "covered"]))})


VERDICT = f"""{SAFER}, vd AS (SELECT *, greatest(lv, CASE rank % 3 WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS lv2, CASE WHEN rank % 3 = 2 AND sev = 'MEDIUM' THEN 'HIGH' ELSE sev END AS s1,
 kk = 'external-api' AND rank % 2 = 0 AS nobaa FROM sp WHERE rank % 3 <> 0),
vf AS (SELECT *, CASE WHEN nobaa THEN CASE s1 WHEN 'INFO' THEN 'LOW' WHEN 'LOW' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END ELSE s1 END AS s2 FROM vd)"""


@query("path_findings", f"""{VERDICT} SELECT concat('phi-flow-', CAST(row_number() OVER (ORDER BY rank) AS VARCHAR)) AS id, s2 AS severity, concat('f', origin, ':1 → f', node, ':2') AS location,
concat('PHI from ', sk, ' (src', origin, ') flows to ', kk, ' (log', node % 3, ')') AS summary, CASE lv2 WHEN 2 THEN 0.9::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS score FROM vf""")
def path_findings(spark, sf):
    return flow.path_findings(flow.apply_verdicts(verdicts(safer(spark, sf)))).select("id", "severity", "location", "summary", "score")


@query("pr_neighbourhood", f"""{EX}, st AS (SELECT src AS a, dst AS b FROM edges_fx UNION SELECT dst, src FROM edges_fx), h0 AS (SELECT doc_id AS n, 0 AS hop FROM documents WHERE doc_id % 100 = 0),
h1 AS (SELECT n, hop FROM h0 UNION SELECT b, 1 FROM h0 JOIN st ON n = a), h2 AS (SELECT n, hop FROM h1 UNION SELECT b, 2 FROM h1 JOIN st ON n = a) SELECT concat('f', n) AS node, min(hop) AS hop FROM h2 GROUP BY n""")
def pr_neighbourhood(spark, sf):
    changed = spark_table(spark, sf, "documents").filter("doc_id % 100 = 0").select(F.lit("all").alias("repo"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("node"))
    return imports.neighbourhood(graph(spark, sf).edges, changed).select("node", "hop")


@query("pr_edges", f"""{EX}, st AS (SELECT src AS a, dst AS b FROM edges_fx UNION SELECT dst, src FROM edges_fx), h0 AS (SELECT doc_id AS n FROM documents WHERE doc_id % 100 = 0),
h1 AS (SELECT n FROM h0 UNION SELECT b FROM h0 JOIN st ON n = a) SELECT concat('f', src) AS src, concat('f', dst) AS dst, 'out' AS way FROM edges_fx WHERE src IN (SELECT n FROM h1)
UNION ALL SELECT concat('f', src), concat('f', dst), 'in' FROM edges_fx WHERE dst IN (SELECT n FROM h1)""")
def pr_edges(spark, sf):
    changed = spark_table(spark, sf, "documents").filter("doc_id % 100 = 0").select(F.lit("all").alias("repo"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("node"))
    e = graph(spark, sf).edges
    return imports.restrict_edges(e, imports.neighbourhood(e, changed, 1)).select("src", "dst", "way")


@query("transform_edges", f"{EX} SELECT concat('f', src) AS src, concat('f', dst) AS dst, slot, src % 13 = 0 AND symbol IN ('s1', 's2') AS transforms FROM edges_fx")
def transform_edges(spark, sf):
    g = graph(spark, sf)
    return flow.transform_edges(g.edges, g.transforms).select("src", "dst", (F.col("ord") % 2).cast("int").alias("slot"), "transforms")


@query("channel_links", f"""WITH em AS (SELECT doc_id AS id, {CH} AS ch FROM documents WHERE doc_id % 97 = 1), li AS (SELECT doc_id AS id, {CH} AS ch FROM documents WHERE doc_id % 89 = 2)
SELECT concat('f', em.id) AS path, em.ch AS channel, count(DISTINCT li.id) AS listeners FROM em JOIN li ON em.ch = li.ch AND em.id <> li.id GROUP BY ALL""")
def channel_links(spark, sf):
    return runtime.channel_links(graph(spark, sf).flows).select("path", "channel", "listeners")


USER = [("*.Example.com", "covered"), ("*.example.net", "no-baa"), ("*.sentry.io", "covered"), ("*.twilio.com", "no-baa"), ("*.example.net", "covered")]
REGISTRY = "(VALUES " + ", ".join(f"('{p}', 'covered')" for p in BAA_COVERED if p != "*.twilio.com") + ", ('*.example.com', 'covered'), ('*.sentry.io', 'covered'), " + ", ".join(
    f"('{p}', 'no-baa')" for p in [*[b for b in BAA_NONE if b != "*.sentry.io"], "*.example.net", "*.twilio.com"]) + ") v(pattern, status)"


@query("endpoint_status", f"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, host, CASE WHEN EXISTS (SELECT 1 FROM {REGISTRY} WHERE status = 'no-baa' AND (ends_with(host, substr(pattern, 2)) OR host = substr(pattern, 3))) THEN 'no-baa'
WHEN EXISTS (SELECT 1 FROM {REGISTRY} WHERE status = 'covered' AND (ends_with(host, substr(pattern, 2)) OR host = substr(pattern, 3))) THEN 'covered' ELSE 'unknown' END AS baa FROM h""")
def endpoint_status(spark, sf):
    table = flow.registry(spark.createDataFrame(USER, "pattern string, status string"), spark)
    return flow.classify_endpoints(spark_table(spark, sf, "pages").select("page_id", "url"), table).select("page_id", "host", "baa")


@query("registry_hosts", f"""WITH h AS (SELECT DISTINCT regexp_extract(url, '([a-z]+\\.[a-z]+)[/?#:]', 1) AS apex FROM pages),
u AS (SELECT DISTINCT concat('*.', apex) AS pattern, CASE WHEN apex LIKE '%.net' THEN 'no-baa' ELSE 'covered' END AS status FROM h WHERE apex <> '')
SELECT pattern, status FROM u UNION SELECT pattern, status FROM (VALUES {', '.join(f"('{p}', 'covered')" for p in BAA_COVERED)}, {', '.join(f"('{p}', 'no-baa')" for p in BAA_NONE)}) v(pattern, status)
WHERE pattern NOT IN (SELECT pattern FROM u)""")
def registry_hosts(spark, sf):
    apex = F.regexp_extract("url", r"([a-z]+\.[a-z]+)[/?#:]", 1)
    own = spark_table(spark, sf, "pages").select(apex.alias("a")).filter("a <> ''").select(
        F.concat(F.lit("*."), "a").alias("pattern"), F.when(F.col("a").endswith(".net"), "no-baa").otherwise("covered").alias("status"))
    return flow.registry(own, spark)


@query("phi_fields", f"""WITH e AS (SELECT lang AS field, min(doc_id) AS o FROM documents GROUP BY lang UNION ALL SELECT 'ssn', 9999), d AS (SELECT * FROM (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(PHI_FIELDS))}) v(field, o))
SELECT field, CAST(min(o) AS BIGINT) AS ord FROM (SELECT * FROM d UNION ALL SELECT field, o + {len(PHI_FIELDS)} FROM e) u GROUP BY field""")
def phi_fields(spark, sf):
    extra = spark_table(spark, sf, "documents").groupBy(F.col("lang").alias("field")).agg(F.min("doc_id").alias("ord"))
    extra = extra.unionByName(spark.createDataFrame([("ssn", 9999)], "field string, ord long"))
    return flow.field_table(spark, extra, fixed.PHI_FIELDS)


@query("merged_profiles", f"""WITH rt AS ({FILE_SQL['runtime_flows']}), n AS (SELECT repo, path, count(*) AS runtime_flows FROM rt GROUP BY ALL),
pf AS ({FILES} SELECT repo, path, CAST(doc_id % 3 AS BIGINT) AS sources FROM files_fx WHERE path LIKE '%.ts')
SELECT coalesce(pf.repo, n.repo) AS repo, coalesce(pf.path, n.path) AS path, coalesce(sources, 0) AS sources, coalesce(runtime_flows, 0) AS runtime_flows FROM pf FULL JOIN n ON pf.repo = n.repo AND pf.path = n.path""")
def merged_profiles(spark, sf):
    f = files(spark, sf)
    profiles = f.filter(F.col("path").endswith(".ts")).select("repo", "path", (F.col("doc_id") % 3).alias("sources"))
    return flow.merge_runtime(profiles, runtime.runtime_flows(f.select("repo", "path", "content")))


EDGE_CTE = f"ed AS ({IMPORT_SQL})"


@query("graph_stats", f"""WITH {EDGE_CTE}, fl AS ({FILES} SELECT repo, path, content, {LANG} IN ('ts', 'js') AS script FROM files_fx),
b AS (SELECT repo, count(*) FILTER (script) AS files_analyzed, count(*) FILTER (NOT script) AS files_skipped FROM fl GROUP BY repo), e AS (SELECT repo, count(*) AS n, count(*) FILTER (external) AS x FROM ed GROUP BY repo)
SELECT b.repo, files_analyzed, 0 AS files_failed, files_skipped, coalesce(n, 0) AS total_edges, coalesce(x, 0) AS candidate_paths, coalesce(n - x, 0) AS verified_leaks FROM b LEFT JOIN e USING (repo)""")
def graph_stats(spark, sf):
    f = files(spark, sf).select("repo", "path", "content")
    e = imports.import_edges(f)
    return flow.graph_stats(f, e, e.filter("external"), e.filter("not external"))


@query("diagnostics", f"""WITH {EDGE_CTE}, fl AS ({FILES} SELECT repo, path, {LANG} IN ('ts', 'js') AS script FROM files_fx)
SELECT repo, 'info' AS level, concat('Skipped ', CAST(count(*) AS VARCHAR), ' non-TS/JS files for import graph') AS message FROM fl WHERE NOT script GROUP BY repo
UNION ALL SELECT repo, 'warn', concat('Could not resolve import ''', dst, ''' from ', src) FROM ed WHERE NOT resolved""")
def diagnostics(spark, sf):
    f = files(spark, sf).select("repo", "path", "content")
    return flow.diagnostics(f, imports.import_edges(f)).drop("ord")


@query("path_normalise", r"""SELECT page_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '.'), lambda x: x), '/') AS path,
lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages""")
def path_normalise(spark, sf):
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    noisy = F.concat(F.lit("zz/../"), F.replace(bare, F.lit("/"), F.lit("/./")))
    return spark_table(spark, sf, "pages").select("page_id", text.normalize_path(noisy).alias("path"), text.hostname(F.col("url")).alias("host"))
