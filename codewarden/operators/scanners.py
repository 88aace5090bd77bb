"""The stock scanners: health-data rules over source lines.

Triggers, severities, categories, summaries and regulation references are
fixed values; explanations are ours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import (BROAD_FIELDS, FHIR_RESOURCES, LOCAL_HOSTS, PHI_BUCKET_WORDS, PHI_MODELS,
                               PHI_ROUTE_WORDS, PHI_TABLES)
from ..functions.jsregex import any_of, js, quote
from ..functions.spans import match_lines
from .rules import SCRIPT_PATH, Hit, RuleOptions, Scanner, finding, not_test, one, one_of, phi_path

# ---------------------------------------------------------------- logs ----

# Log calls, and the regulation cited.
LOG_CALL = js(r"\b(?:console\.(?:log|error|warn|info|debug)|logger\.(?:info|warn|error|debug)"
              r"|log\.(?:info|error|debug)|debug\(|trace\()")
LOG_REG = "45 CFR §164.312(b), §164.530(c)"


def field_pattern(name: str) -> str:
    n = quote(name)
    if name.lower() in BROAD_FIELDS:
        return js(rf"\.{n}\b|\['{n}'\]|\b{n}\s*[:=]")
    return js(rf"\b{n}\b")


def first_field(line: Column, fields: list[str]) -> Column:
    """First field in list order that the line mentions, or null.

    The fields are one constant array: a plain substring test picks the few
    candidates, and only those are checked with their pattern.
    """
    # Two joined literals that the optimizer folds into one constant array.
    sep = "\u0001"
    names = F.split(F.lit(sep.join(fields)), sep)
    patterns = F.split(F.lit(sep.join(field_pattern(f) for f in fields)), sep)
    table = F.arrays_zip(names.alias("f"), patterns.alias("p"))
    found = F.filter(table, lambda x: line.contains(x["f"]) & F.regexp_like(line, x["p"]))
    return F.get(found, 0)["f"]


def _open_context(line: Column) -> Column:
    opens = F.regexp_count(line, F.lit(r"[{(]"))
    closes = F.regexp_count(line, F.lit(r"[})]"))
    ticks = F.regexp_count(line, F.lit("`"))
    return (opens > closes) | line.rlike(js(r",\s*$")) | (ticks % 2 != 0)


def _log_values(h: Hit, o: RuleOptions) -> dict[str, Column]:
    names = o.fields
    is_log = h.line.rlike(LOG_CALL)
    here = F.when(is_log, first_field(h.line, names))
    # The line below counts before the line above.
    beside = F.coalesce(first_field(h.offset(1), names), first_field(h.offset(-1), names))
    return {"here": here, "beside": F.when(is_log & _open_context(h.line), beside)}


def _logs(h: Hit, v: dict[str, Column]):
    here, beside = v["here"], F.when(v["here"].isNull(), v["beside"])
    cat = "PHI Exposure in Logs"
    yield one(here.isNotNull(), "CRITICAL", cat, F.format_string('PHI field "%s" logged directly', here),
              F.concat(F.lit("The log call itself names the field "), here),
              F.concat(F.lit("Drop or mask "), here, F.lit(" before logging.")), LOG_REG)
    yield one(beside.isNotNull(), "HIGH", cat, F.format_string('PHI field "%s" in multiline log context', beside),
              F.concat(F.lit("A log call spanning several lines names the field "), beside),
              F.concat(F.lit("Drop or mask "), beside, F.lit(" before logging.")), LOG_REG)


PHI_IN_LOGS = Scanner(
    "phi-in-logs", "PHI in log statements",
    lambda p, o: not_test(p, "default", o) & p.rlike(SCRIPT_PATH),
    ("console.", "logger.", "log.", "debug(", "trace("), _logs, _log_values)

# --------------------------------------------------------- broad queries ----

# Broad-query patterns, with room for line breaks between words.
SELECT_STAR = js(r"SELECT[\s\S]{0,30}\*[\s\S]{0,30}FROM[\s\S]{0,30}?\b(\w+)\b", "i")
ORM_FIND = js(r"\b([A-Z]\w+)\.(findAll|find)\s*\(")
MIN_REG = "45 CFR §164.502(b)"


def _broad(path: Column, content: Column, o: RuleOptions) -> Column:
    cat = "Overly Broad PHI Query"
    star = F.arrays_zip(match_lines(content, SELECT_STAR).alias("line_no"),
                        F.regexp_extract_all(content, F.lit(SELECT_STAR), F.lit(1)).alias("t"))
    stars = F.transform(star, lambda x: F.struct(
        x["line_no"].alias("line_no"), F.lit(0).alias("rule"),
        finding(F.lower(x["t"]).isin(PHI_TABLES), "HIGH", cat,
                F.concat(F.lit('SELECT * from PHI table "'), x["t"], F.lit('"')),
                F.concat(F.lit("Every column is read from "), x["t"]),
                F.concat(F.lit("Name the columns needed from "), x["t"]), MIN_REG).alias("f")))
    # The call text that follows is captured by look-ahead, so calls may nest.
    ahead = ORM_FIND + r"(?=([\s\S]{0,200}))"

    def part(g: int) -> Column:
        return F.regexp_extract_all(content, F.lit(ahead), F.lit(g))

    orm = F.arrays_zip(match_lines(content, ORM_FIND).alias("line_no"), part(0).alias("m"), part(1).alias("model"),
                       part(2).alias("op"), part(3).alias("rest"))

    def call(x: Column) -> Column:
        args = F.split_part(F.left(F.concat(x["m"], x["rest"]), F.lit(200)), F.lit(")"), F.lit(1))
        broad = x["model"].isin(PHI_MODELS) & ~args.rlike(js(r"\battributes\s*:"))
        name = F.concat(x["model"], F.lit("."), x["op"], F.lit("()"))
        return F.struct(x["line_no"].alias("line_no"), F.lit(1).alias("rule"), finding(
            broad, "MEDIUM", cat, F.concat(name, F.lit(" without explicit attribute selection")),
            F.concat(name, F.lit(" reads every attribute of a PHI model")),
            F.lit("List the attributes needed."), MIN_REG).alias("f"))

    return F.filter(F.concat(stars, F.transform(orm, call)), lambda x: x["f"].isNotNull())


SELECT_ALL = Scanner(
    "select-star", "Broad queries on PHI tables",
    lambda p, o: p.rlike(js(r"\.[tj]sx?$|\.sql$", "i")), ("select", ".find"), lambda h, v: (), whole=_broad)

# --------------------------------------------------------------- http ----

# Fixed value: a plain-HTTP URL.
HTTP_URL = js(r"""http:\/\/([^\s"'`,;)}\]]+)""", "i")


def url_host(fragment: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(fragment, r"^[^/?#]*", 0), r":\d+\z", "")


def _http(h: Hit, v: dict[str, Column]):
    urls = F.regexp_extract_all(h.line, F.lit(HTTP_URL), F.lit(1))
    yield F.transform(urls, lambda u: finding(
        ~url_host(u).isin(LOCAL_HOSTS), "CRITICAL", "Unencrypted Transport", "Plain HTTP URL in PHI-handling file",
        F.concat(F.lit("http://"), u, F.lit(" carries data in clear text")),
        "Use https, or allow-list the host.", "45 CFR §164.312(e)"))


HTTP_PHI = Scanner(
    "http-phi", "Plain HTTP in PHI code",
    lambda p, o: not_test(p, "http", o) & phi_path(p, o), ("http://",), _http)

# --------------------------------------------------------------- fhir ----

# Signs of an HTTP client, scopes and export calls.
HTTP_CLIENT = any_of([
    r"\bimport\b.*\bfetch\b", r"\bimport\b.*\baxios\b", r"\bimport\b.*\bgot\b", r"\bimport\b.*\brequest\b",
    r"\bimport\b.*\bky\b", r"\brequire\s*\(\s*['\"]axios['\"]\s*\)", r"\brequire\s*\(\s*['\"]got['\"]\s*\)",
    r"\brequire\s*\(\s*['\"]node-fetch['\"]\s*\)", r"\brequire\s*\(\s*['\"]request['\"]\s*\)",
    r"\brequire\s*\(\s*['\"]ky['\"]\s*\)", r"\bimport\b.*['\"]https?['\"]",
    r"\brequire\s*\(\s*['\"]https?['\"]\s*\)", r"\bfetch\s*\("])
FHIR_SEARCH = js(rf"""/({'|'.join(FHIR_RESOURCES)})\?[^\s"'`]*""")
BROAD_SCOPE = js(r"['\"`]user\/\*\.\*['\"`]")
READ_SCOPE = js(r"['\"`]user\/\*\.read['\"`]")
EXPORT_TYPED = js(r"\$export[^'\"`\s]*_type")


def _fhir(h: Hit, v: dict[str, Column]):
    client = h.flags["client"]
    loose = client & ~h.close(3, 3, lambda x: x.contains("_elements"))
    names = F.regexp_extract_all(h.line, F.lit(FHIR_SEARCH), F.lit(1))
    yield F.transform(names, lambda n: finding(
        loose, "HIGH", "FHIR Minimum Necessary", F.concat(F.lit("FHIR "), n, F.lit(" search without `_elements` restriction")),
        F.concat(F.lit("The search returns whole resources of type "), n),
        "Restrict the result with _elements.", MIN_REG))
    scope = "FHIR Scope Overprivilege"
    yield one(client & h.line.rlike(BROAD_SCOPE), "HIGH", scope, "Overly broad SMART scope `user/*.*`",
              "The scope reads and writes every resource.", "Ask for patient-level scopes.", "45 CFR §164.312(a)")
    yield one(client & h.line.rlike(READ_SCOPE), "MEDIUM", scope, "Broad SMART scope `user/*.read`",
              "The scope reads every resource.", "Ask for patient-level scopes.", "45 CFR §164.312(a)")
    yield one(client & h.line.contains("$export") & ~h.line.rlike(EXPORT_TYPED), "HIGH", "FHIR Bulk Export",
              "Bulk `$export` without `_type` restriction", "The export covers every resource type.",
              "Restrict the export with _type.", MIN_REG)


FHIR_RULES = Scanner(
    "fhir-rules", "FHIR request rules", lambda p, o: F.lit(True),
    tuple(f"/{r.lower()}?" for r in FHIR_RESOURCES) + ("user/*.", "$export"), _fhir,
    flags=lambda p, c, o: {"client": c.rlike(HTTP_CLIENT)})

# ---------------------------------------------------------------- hl7 ----

# HL7 v2 patterns.
HL7_LOG = js(r"\b(?:console\.(?:log|warn|error|info|debug|trace)|logger\.(?:log|warn|error|info|debug|trace|fatal))\s*\(", "i")
HL7_NAME = js(r"\b(?:hl7|adt|oru|hl7message|hl7msg|hl7_message|hl7_msg|adtMessage|adtEvent|oruMessage|oruResult"
              r"|rawMessage|rawHl7)\b", "i")
RAW_HEADER = js(r"MSH\|\^\~\\{1,2}&\|")
SEGMENT = js(r"\b(?:pid|nk1|in1|in2|dg1|gt1)", "i")
HEADER_NAME = js(r"\bmsh", "i")
RAW_SEGMENT = js(r"\b(?:PID|NK1|IN1|IN2|DG1|GT1)\s*\|")


def _hl7(h: Hit, v: dict[str, Column]):
    log = h.line.rlike(HL7_LOG)
    fix = "Log only the message control id."
    # (condition, severity, summary); the first that holds decides the line.
    steps = [
        (log & h.line.rlike(RAW_HEADER), "CRITICAL", "Raw HL7v2 message logged"),
        (h.line.rlike(RAW_SEGMENT), "HIGH", "Raw HL7v2 PHI segment in code"),
        (log & h.line.rlike(HL7_NAME), "CRITICAL", "HL7v2 message variable logged"),
        (log & h.line.rlike(SEGMENT), "HIGH", "HL7v2 PHI segment referenced in log"),
        (log & h.line.rlike(HEADER_NAME), "MEDIUM", "HL7v2 MSH segment referenced in log"),
    ]
    chain = None
    for cond, sev, text in steps:
        body = finding(F.lit(True), sev, "HL7v2 PHI Exposure", text, F.lit("HL7 v2 content on this line."), fix, LOG_REG)
        chain = F.when(cond, body) if chain is None else chain.when(cond, body)
    yield F.array(chain)


HL7_PHI = Scanner("hl7-phi", "HL7 v2 content", lambda p, o: not_test(p, "hl7", o),
                  ("pid", "nk1", "in1", "in2", "dg1", "gt1", "console.", "logger."), _hl7)

# --------------------------------------------------------- encryption ----

# Connection, storage, crypto, cache and client patterns.
DB_URI = js(r"['\"`]((?:mongodb|postgres|postgresql|mysql):\/\/[^'\"`]+)['\"`]", "i")
S3_CALL = js(r"\b(?:s3\.(?:putObject|upload)|(?:new\s+)?PutObjectCommand|s3Client\.send)\s*\(", "i")
S3_SAFE = js(r"ServerSideEncryption|SSECustomerAlgorithm|KMSMasterKeyID")
BUCKET = js(r"Bucket:\s*['\"]([^'\"]+)['\"]", "i")
AZURE_CALL = js(r"blobClient\.upload\b", "i")
GCS_CALL = js(r"bucket\.upload\b", "i")
OLD_CIPHER = js(r"crypto\.createCipher\s*\(")
CIPHER_IV = js(r"crypto\.createCipheriv\s*\(\s*['\"]([^'\"]+)['\"]")
CIPHER_KEY = js(r"crypto\.createCipheriv\s*\(\s*['\"][^'\"]+['\"]\s*,\s*['\"][^'\"]+['\"]")
WEAK_CIPHER = js(r"\b(des|des-ede3|rc4|ecb)\b", "i")
HASH_CALL = js(r"crypto\.createHash\s*\(\s*['\"]([^'\"]+)['\"]")
WEAK_HASH = js(r"\b(md5|sha1)\b", "i")
WEAK_MODULE = js(r"CryptoJS\.(DES|TripleDES|RC4|MD5|SHA1)\b")
NO_VERIFY = js(r"rejectUnauthorized\s*:\s*false")
NO_VERIFY_ENV = js(r"NODE_TLS_REJECT_UNAUTHORIZED\s*[=:]\s*['\"]0['\"]")
OLD_TLS = js(r"['\"]TLSv1(?:\.1)?['\"]")
NEW_TLS = js(r"TLSv1\.[23]")
REDIS_URI = js(r"['\"`](redis:\/\/[^'\"`]+)['\"`]", "i")
REDIS_NEW = js(r"new\s+Redis\s*\(\s*\{")
MEMCACHED_NEW = js(r"new\s+Memcached\s*\(")
BASE_URL = js(r"(?:baseURL|base_url|prefixUrl)\s*:\s*['\"`](http:\/\/[^'\"`]+)['\"`]", "i")
REST_REG = "45 CFR §164.312(a)(2)(iv)"
TRANSIT_REG = "45 CFR §164.312(e)(2)(ii)"


def uri_host(uri: Column) -> Column:
    """Host of scheme://[user@]host[:port]/… as the rules read it."""
    rest = F.regexp_replace(uri, r"^[a-z]+:\/\/", "")
    rest = F.when(rest.contains("@"), F.split_part(rest, F.lit("@"), F.lit(2))).otherwise(rest)
    return F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r":\d+\z", "")


def _encryption_values(h: Hit, o: RuleOptions) -> dict[str, Column]:
    def first(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(h.line, pattern, 1), F.lit(""))

    # The old cipher call settles its line: no other crypto check applies.
    old = h.line.rlike(OLD_CIPHER)
    return {"old": old, "cipher": F.when(~old, first(CIPHER_IV)), "digest": F.when(~old, first(HASH_CALL)),
            "module": F.when(~old, first(WEAK_MODULE)), "base": first(BASE_URL),
            "bucket": one_of(F.regexp_extract(h.line, BUCKET, 1), PHI_BUCKET_WORDS)}


def _encryption(h: Hit, v: dict[str, Column]):
    phi = h.flags["phi"]

    def db(uri: Column) -> Column:
        scheme = F.lower(F.split_part(uri, F.lit("://"), F.lit(1)))
        low = F.lower(uri)
        safe = (F.when(scheme == "mongodb", low.rlike(r"[?&](tls|ssl)=true"))
                .when(scheme.isin("postgres", "postgresql"), low.rlike(r"[?&]sslmode=(require|verify-ca|verify-full)"))
                .otherwise(low.rlike(r"[?&]ssl=true")))
        return finding(phi & ~uri_host(uri).isin(LOCAL_HOSTS) & ~safe, "CRITICAL", "Unencrypted Database Connection",
                       F.concat(F.lit("Unencrypted "), scheme, F.lit(" connection without TLS/SSL")),
                       F.concat(scheme, F.lit(" URI has no TLS parameter")),
                       "Turn on TLS in the connection string.",
                       "45 CFR §164.312(a)(2)(iv), §164.312(e)(2)(ii)")

    yield F.transform(F.regexp_extract_all(h.line, F.lit(DB_URI), F.lit(1)), db)

    storage = "Unencrypted Cloud Storage"
    yield one(h.line.rlike(S3_CALL) & (v["bucket"] | phi) & ~h.close(5, 5, lambda x: x.rlike(S3_SAFE)), "HIGH", storage,
              "S3 upload without server-side encryption", "No encryption option near the upload.",
              "Set ServerSideEncryption.", REST_REG)
    yield one(phi & h.line.rlike(AZURE_CALL) & ~h.close(5, 5, lambda x: F.lower(x).contains("encrypt")), "HIGH",
              storage, "Azure Blob upload without encryption configuration", "No encryption option near the upload.",
              "Configure encryption for the upload.", REST_REG)
    yield one(phi & h.line.rlike(GCS_CALL) & ~h.close(5, 5, lambda x: x.rlike("encryptionKey|kmsKeyName")), "HIGH",
              storage, "GCS upload without encryption configuration", "No encryption key near the upload.",
              "Set kmsKeyName or encryptionKey.", REST_REG)

    old, cipher, digest, module = v["old"], v["cipher"], v["digest"], v["module"]
    weak = "Weak Cryptography"
    yield one(old, "HIGH", weak, "Deprecated crypto.createCipher() — use createCipheriv() instead",
              "The key is derived without a salt.", "Use createCipheriv with a derived key and random IV.", REST_REG)
    yield one(cipher.rlike(WEAK_CIPHER), "HIGH", weak, F.concat(F.lit("Weak/deprecated cipher algorithm: "), cipher),
              F.concat(cipher, F.lit(" is weak or deprecated")), "Use AES-256-GCM.", REST_REG)
    yield one(cipher.isNotNull() & h.line.rlike(CIPHER_KEY), "HIGH", "Hardcoded Encryption Key",
              "Hardcoded encryption key detected in crypto call", "The key is a string literal.",
              "Load the key from a key manager.", REST_REG)
    yield one(digest.rlike(WEAK_HASH), "HIGH", weak, F.concat(F.lit("Weak hash algorithm: "), digest),
              F.concat(F.upper(digest), F.lit(" is broken")), "Use SHA-256.", REST_REG)
    yield one(module.isNotNull(), "HIGH", weak, F.concat(F.lit("Weak CryptoJS algorithm: "), module),
              F.concat(F.lit("CryptoJS."), module, F.lit(" is weak")), "Use AES or SHA-256.", REST_REG)
    off = "TLS Validation Disabled"
    yield one(~old & h.line.rlike(NO_VERIFY), "CRITICAL", off,
              "TLS certificate validation disabled (rejectUnauthorized: false)", "Certificates are not checked.",
              "Configure the CA certificates.", TRANSIT_REG)
    yield one(~old & h.line.rlike(NO_VERIFY_ENV), "CRITICAL", off,
              "TLS validation globally disabled via NODE_TLS_REJECT_UNAUTHORIZED", "Certificates are not checked.",
              "Remove the setting.", TRANSIT_REG)
    yield one(~old & h.line.rlike(OLD_TLS) & ~h.line.rlike(NEW_TLS), "HIGH", "Weak TLS Version",
              "Deprecated TLS version (TLSv1/1.1) in use", "The protocol version is deprecated.",
              "Require TLSv1.2 or later.", TRANSIT_REG)

    cache = "Unencrypted Cache Connection"
    uris = F.regexp_extract_all(h.line, F.lit(REDIS_URI), F.lit(1))
    yield F.transform(uris, lambda u: finding(
        phi & ~h.line.contains("rediss://"), "HIGH", cache, "Redis connection without TLS (redis:// vs rediss://)",
        "The cache connection is plain text.", "Use rediss://.", TRANSIT_REG))
    yield one(phi & h.line.rlike(REDIS_NEW) & ~h.close(5, 5, lambda x: x.rlike(js(r"\btls\s*:", "i"))), "HIGH", cache,
              "Redis client created without TLS configuration", "No tls option near the constructor.",
              "Add a tls option.", TRANSIT_REG)
    yield one(phi & h.line.rlike(MEMCACHED_NEW), "MEDIUM", cache, "Memcached connection — inherently unencrypted",
              "The protocol has no TLS.", "Use a cache with TLS.", TRANSIT_REG)
    base = v["base"]
    yield one(phi & base.isNotNull() & ~uri_host(base).isin(LOCAL_HOSTS), "HIGH", "Insecure API Client",
              "API client configured with HTTP instead of HTTPS",
              F.concat(F.lit("Base URL on plain HTTP: "), uri_host(base)), "Use https.", TRANSIT_REG)


ENCRYPTION = Scanner(
    "encryption", "Encryption at rest and in transit",
    lambda p, o: not_test(p, "default", o) & p.rlike(SCRIPT_PATH),
    ("mongodb://", "postgres://", "postgresql://", "mysql://", "putobject", "s3.upload", "s3client.send",
     "blobclient.upload", "bucket.upload", "createcipher", "createhash", "cryptojs.", "rejectunauthorized",
     "node_tls_reject_unauthorized", "tlsv1", "redis", "memcached", "baseurl", "base_url", "prefixurl"),
    _encryption, _encryption_values, flags=lambda p, c, o: {"phi": phi_path(p, o)})

# -------------------------------------------------------- audit trail ----

# Audit, route, FHIR, SQL and ORM patterns.
AUDIT_WORD = js(r"\b(?:audit|auditLog|auditEvent|createAuditEvent|recordAudit|logAccess|accessLog|auditMiddleware|withAudit)\b", "i")
AUDIT_MARK = js(r"@(?:Audited|Audit|LogAccess)\b")
AUDIT_EMIT = js(r"(?:emit\s*\(\s*['\"]audit|eventBus\b)", "i")
ROUTE = js(r"\b(?:router|app|fastify|server)\.(get|post|put|patch|delete)\s*\(\s*['\"`]([^'\"`]+)['\"`]", "i")
FHIR_CALL = js(r"fhirClient\.(read|search|create|update|delete|vread|history)\s*\(\s*['\"]([^'\"]+)['\"]")
SQL_CALLS = [
    ("SELECT", js(r"db\.query\s*\(\s*['\"`]SELECT\s+.*?\bFROM\s+(\w+)", "i")),
    ("INSERT", js(r"db\.query\s*\(\s*['\"`]INSERT\s+INTO\s+(\w+)", "i")),
    ("UPDATE", js(r"db\.query\s*\(\s*['\"`]UPDATE\s+(\w+)", "i")),
    ("DELETE", js(r"db\.query\s*\(\s*['\"`]DELETE\s+FROM\s+(\w+)", "i")),
]
ORM_CALL = js(r"\b(\w+)\.(findById|findOne|findAll|find|create|update|destroy|save|deleteOne|deleteMany|updateOne|updateMany)\b")
ORM_READS = ["findById", "findOne", "findAll", "find"]
AUDIT_CALL = js(r"\b(?:auditLog|audit|accessLog)\.(?:record|log|create|write|emit)\s*\(", "i")
AUDIT_PARTS = [
    ("who (userId/actor)", js(r"\b(?:userId|user_id|actor|principal|subject|performedBy|agent)\b")),
    ("what (resource/action)", js(r"\b(?:resource|entity|target|object|resourceType|action)\b")),
    ("when (timestamp)", js(r"\b(?:timestamp|time|date|when|occurredAt|recorded)\b")),
    ("where (ip/source)", js(r"\b(?:ip\b|ipAddress|source|origin|sourceIp|address)\b")),
]
FILE_AUDIT = js(r"\b(?:app|router|server)\.use\s*\(\s*(?:audit|auditMiddleware)", "i")
SERVICE_CALL = js(r"\b\w+Service\.\w+\s*\(")
AUDIT_REG = "45 CFR §164.312(b)"


def _audited(x: Column) -> Column:
    return x.rlike(AUDIT_WORD) | x.rlike(AUDIT_MARK) | x.rlike(AUDIT_EMIT)


def call_block(h: Hit) -> Column:
    """Text of a call: up to 15 lines, ending where the parentheses close."""
    lines = F.slice(h.near, h.at + 1, F.lit(15))
    state = F.aggregate(
        lines, F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(False).alias("done")),
        lambda acc, x: F.when(acc["done"], acc).otherwise(_add_line(acc, x)))
    return state["text"]


def _add_line(acc: Column, x: Column) -> Column:
    opens = F.length(x) - F.length(F.replace(x, F.lit("("), F.lit("")))
    closes = F.length(x) - F.length(F.replace(x, F.lit(")"), F.lit("")))
    depth = acc["depth"] + opens - closes
    started = acc["open"] | (opens > 0)
    return F.struct(F.concat(acc["text"], x, F.lit("\n")).alias("text"), depth.alias("depth"),
                    started.alias("open"), (started & (depth <= 0)).alias("done"))


def _audit_values(h: Hit, o: RuleOptions) -> dict[str, Column]:
    route = F.nullif(F.regexp_extract(h.line, ROUTE, 2), F.lit(""))
    bare = (route.isNotNull() & ~h.flags["covered"] & one_of(route, PHI_ROUTE_WORDS)
            & ~h.above(3, lambda x: x.rlike(AUDIT_MARK)) & ~h.close(20, 20, _audited))
    # First SQL form that matches decides the operation and table.
    sql = None
    for op, pattern in SQL_CALLS:
        body = F.struct(F.lit(op).alias("op"), F.lower(F.regexp_extract(h.line, pattern, 1)).alias("t"))
        cond = h.line.rlike(pattern)
        sql = F.when(cond, body) if sql is None else sql.when(cond, body)
    model = F.regexp_extract(h.line, ORM_CALL, 1)
    verb = F.nullif(F.regexp_extract(h.line, FHIR_CALL, 1), F.lit(""))
    watched = F.filter(F.array(sql["t"]), lambda t: t.isin(PHI_TABLES))
    touches = (F.size(watched) > 0) | model.isin(PHI_MODELS)
    block = call_block(h)
    return {
        "route": F.when(bare, route), "sql": sql, "model": model,
        "verb": verb, "orm": F.regexp_extract(h.line, ORM_CALL, 2),
        "quiet": touches & ~h.close(15, 15, _audited),
        "silent": verb.isNotNull() & ~h.close(15, 15, lambda x: x.contains("AuditEvent") | x.rlike(AUDIT_WORD) | x.rlike(AUDIT_EMIT)),
        "block": F.when(h.line.rlike(AUDIT_CALL), block),
    }


def _audit(h: Hit, v: dict[str, Column]):
    route = v["route"]
    service = h.close(0, 20, lambda x: x.rlike(SERVICE_CALL))
    yield one(route.isNotNull(), F.when(service, F.lit("MEDIUM")).otherwise(F.lit("HIGH")), "Route Without Audit Trail",
              F.concat(F.lit("PHI route "), route, F.lit(" without audit logging")),
              F.concat(F.lit("No audit call near the handler of "), route),
              F.lit("Add audit logging, or check that the service audits."), AUDIT_REG)

    verb, resource = v["verb"], F.regexp_extract(h.line, FHIR_CALL, 2)
    yield one(v["silent"] & (resource != "AuditEvent"),
              F.when(verb.isin("create", "update", "delete"), F.lit("CRITICAL")).otherwise(F.lit("HIGH")),
              "FHIR Operation Without Audit",
              F.concat(F.lit("FHIR "), verb, F.lit("('"), resource, F.lit("') without AuditEvent")),
              F.concat(verb, F.lit(" on "), resource, F.lit(" leaves no AuditEvent")),
              "Create an AuditEvent.", AUDIT_REG)

    sql, model, call = v["sql"], v["model"], v["orm"]
    bad_sql = F.coalesce(sql["t"].isin(PHI_TABLES), F.lit(False)) & v["quiet"]
    cat = "Database PHI Access Without Audit"
    yield one(bad_sql, F.when(sql["op"] == "SELECT", F.lit("HIGH")).otherwise(F.lit("CRITICAL")), cat,
              F.concat(sql["op"], F.lit(' on PHI table "'), sql["t"], F.lit('" without audit trail')),
              F.concat(sql["op"], F.lit(" without audit call nearby")), "Add audit logging.", AUDIT_REG)
    yield one(~bad_sql & model.isin(PHI_MODELS) & v["quiet"],
              F.when(call.isin(ORM_READS), F.lit("HIGH")).otherwise(F.lit("CRITICAL")), cat,
              F.concat(model, F.lit("."), call, F.lit("() without audit trail")),
              F.concat(call, F.lit(" without audit call nearby")), "Add audit logging.", AUDIT_REG)

    block = v["block"]
    missing = F.filter(F.array(*[F.when(~block.rlike(p), F.lit(n)) for n, p in AUDIT_PARTS]), lambda x: x.isNotNull())
    yield one(block.isNotNull() & (F.size(missing) >= 2), "MEDIUM", "Incomplete Audit Log Entry",
              F.concat(F.lit("Audit log entry missing "), F.size(missing).cast("string"), F.lit(" required field categories")),
              F.concat(F.lit("Missing: "), F.array_join(missing, ", ")),
              F.lit("Add the missing fields."), "45 CFR §164.312(b), §164.530(j)")


AUDIT_TRAIL = Scanner(
    "audit-trail", "Audit trail completeness",
    lambda p, o: not_test(p, "default", o) & p.rlike(SCRIPT_PATH),
    ("router.", "app.", "fastify.", "server.", "fhirclient.", "db.query", ".find", ".create", ".update",
     ".destroy", ".save", ".delete", "auditlog.", "audit.", "accesslog."),
    _audit, _audit_values, flags=lambda p, c, o: {"covered": c.rlike(FILE_AUDIT)})

STOCK = (PHI_IN_LOGS, SELECT_ALL, HTTP_PHI, FHIR_RULES, HL7_PHI, ENCRYPTION, AUDIT_TRAIL)
