"""Driver queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, collocations, exact_dedup, hard_negatives, lang_id, media, mixing, neighbours, ngram_join, secrets, substring_dedup, token_counts
from .common import table, texts


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages; one that loses none has no removed spans."""
    cut = substring_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    some = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    removed = some(F.col("removed"), substring_dedup.SPANS)
    span = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", F.array_join(F.transform(removed, span), ",").alias("removed_spans"), size(removed).alias("removed_chars"),
                      size(F.col("kept")).alias("kept_chars"), some(F.col("first_ids"), "array<long>").alias("first_ids"),
                      F.sha2(texts(), 256).alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.located(docs).select("doc_id", "source", "phase", "slot", "block", "offset")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.recipes(table(spark, sf_dir, "documents")).drop("_cw_key")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     r AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r"""


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_column(table(spark, sf_dir, "documents"), kind=media.UP)
    return (media.media_features(stored)
            .select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
                    F.lower(F.hex("phash")).alias("feature")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (lang_id.predict(docs.select("doc_id", "text", lang_id.held_out().alias("held_out")), lang_id.fit(docs))
            .select("doc_id", "held_out", "lang_pred", "score"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def _op9_kind(number: int, name: str, pattern: str, group: int = 0) -> str:
    """Matches of one kind with their offsets; long pieces of a text are counted, not kept."""
    return rf"""
  SELECT doc_id, source, {number} AS kind, '{name}' AS name, unnest(range(len(hits))) AS i,
         unnest([CAST(list_sum([length(g) FOR g IN list_slice(gaps, 1, x)])
                 + coalesce(list_sum([length(g) FOR g IN list_slice(hits, 1, x - 1)]), 0) AS BIGINT) FOR x IN range(1, len(hits) + 1)]) AS start,
         unnest([length(g) FOR g IN hits]) AS size, unnest(vals) AS v
  FROM (SELECT doc_id, source, string_split_regex(coalesce(text, ''), '{pattern}') AS gaps,
               regexp_extract_all(coalesce(text, ''), '{pattern}') AS hits, regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) AS vals
        FROM documents WHERE regexp_matches(coalesce(text, ''), '{pattern}'))"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ["password", "passwd", "secret", "token", "api_?key"]))
_ASSIGN = "(" + _NAMES + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
# Mixed words are cut out of all long words, since this dialect has no lookahead.
OP9_SQL = rf"""
WITH m AS ({_op9_kind(0, "assign", _ASSIGN, 2)}
  UNION ALL {_op9_kind(1, "access", "AKIA[A-Z0-9]+")}
  UNION ALL {_op9_kind(2, "hex", "[0-9a-f]{32,}")}
  UNION ALL {_op9_kind(3, "owned", "[A-Za-z0-9+/_=-]{20,}")}),
c AS (SELECT * FROM m WHERE CASE kind WHEN 0 THEN length(v) >= 8 WHEN 1 THEN length(v) >= 16 WHEN 2 THEN true
      ELSE regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') END),
o AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM c GROUP BY v),
s AS (SELECT c.*, owners <= 2 AND repositories <= 8 AS live FROM c JOIN o USING (v) WHERE kind < 3 OR (owners <= 2 AND repositories <= 8)),
t AS (SELECT *, name || ':' || start || ':' || (start + size) AS label FROM s)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(label, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(label, ',' ORDER BY start, kind), '') AS spans,
       count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id"""


#: A conversation that speaks in the template's own markers.
MARKED = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written in several layouts first, so that fingerprints select; rows of an existing conversation -7 join the added one."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    marked = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    return chat_format.digests(chat_format.render(chat_format.turn_rows(chat_format.in_layouts(rows.unionByName(marked)))))


OP10_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS body,
         replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\l') AS head FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) AS sizes(size) WHERE len(ws) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT c.*, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 :], ' ') AS rest FROM c, (VALUES (1), (2)) AS cuts(k) WHERE k < size),
s AS (SELECT k.lang, k.phrase, k.size, k.a, k.k, x.f AS l, y.f AS r, (1000000 * k.a::HUGEINT * k.a) // (x.f::HUGEINT * y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER t AS rank, b.phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b JOIN n USING (lang) LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase AND b.size = 2
WHERE longer IS NULL OR 100 * longer < 50 * a
WINDOW t AS (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase)
QUALIFY row_number() OVER t <= 2000"""


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_source_mix": op3_source_mix,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_media_columns": op5_media_columns,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_secret_scan": op9_secret_scan,
    "op10_chat_format": op10_chat_format,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_neighbours": op13_neighbours,
    "pipeline": pipeline,
}
ORACLES = {
    "op4_exact_dedup": OP4_SQL,
    "op9_secret_scan": OP9_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
