"""Agent-session transcripts: JSON lines to events, tool calls and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsregex import SPACE
from ..functions.text import trim

# Line types that carry no event, and how results are cut.
NOISE = ["permission-mode", "file-history-snapshot", "attachment", "last-prompt", "ai-title", "summary"]
OK_CHARS = 80
ERROR_CHARS = 400


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, pos, line): ``pos`` is the line number within its file.

    A large file is read in several splits.  Lines are numbered per split and
    the splits of a file are added up, so no task sees a whole file.
    """
    raw = (spark.read.text(path)
           .select("value", F.col("_metadata.file_path").alias("session"),
                   F.col("_metadata.file_block_start").alias("_at"))
           .withColumn("_row", F.monotonically_increasing_id()))
    inside = Window.partitionBy("session", "_at").orderBy("_row")
    before = Window.partitionBy("session").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    base = (raw.groupBy("session", "_at").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return (raw.withColumn("_in", F.row_number().over(inside)).join(base, ["session", "_at"])
            .select("session", (F.col("_in") + F.col("_base")).alias("pos"), F.col("value").alias("line")))


# What a line and a block of its content are read as, each in one cast.  A value that does not fit is null.
_HEAD = "struct<type:string,sessionId:string,timestamp:string,uuid:string,message:struct<model:string>>"
_BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:variant,tool_use_id:string,is_error:string,content:string>"
# How the text of any JSON value but a string begins or is; every other text was a string.
PLAIN = r"^(?:[\[{]|(?:-?[0-9][0-9.eE+-]*|true|false)$)"


def _get(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def only_string(s: Column, v: Column, field: str) -> Column:
    """``s``, the field as text, only when it is a JSON string: its type is looked up where the text leaves it open."""
    return F.when(~s.rlike(PLAIN), s).when(s.isNotNull() & (F.schema_of_variant(_get(v, field)) == "STRING"), s)


def _text(v: Column, field: str) -> Column:
    """A field only when it is a JSON string."""
    return F.when(F.schema_of_variant(_get(v, field)) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def _list(v: Column) -> Column:
    """Items of a JSON array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _join(parts: Column) -> Column:
    """Join with newlines; null when there is nothing to join."""
    kept = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def _flat(v: Column) -> Column:
    """Result content: a string, or the texts of its blocks."""
    items = _list(v)
    parts = F.filter(F.transform(items, lambda b: F.coalesce(_text(b, "text"), _text(b, "content"))), lambda x: x.isNotNull())
    alone = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(items.isNotNull(), F.array_join(parts, "\n")).otherwise(F.coalesce(alone, F.lit("")))


def cut(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("…"))).otherwise(s)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed line records; map-only.

    ``kind`` is user, assistant, system, noise, unknown or bad; the last two
    count as warnings.
    """
    # Asked of the line itself: a filter on the trimmed text would trim again wherever it is pushed to.
    d = (lines.filter(F.col("line").rlike(rf"(?s:(?!{SPACE}).)")).withColumn("_t", trim(F.col("line")))
         .withColumn("_v", F.try_parse_json("_t")).withColumn("_h", F.try_variant_get("_v", "$", _HEAD)).withColumn("_type", F.col("_h.type")))
    v, h = F.col("_v"), F.col("_h")
    kind = (F.when(v.isNull() | ~F.col("_t").startswith("{"), "bad").when(F.col("_type").isin(NOISE), "noise")
            .when(F.col("_type").isin("user", "assistant", "system"), F.col("_type")).otherwise("unknown"))
    # Blocks with their type, read once; only objects have one.  Types are only compared with names, which no other value looks like.
    content = lambda kind: F.when(F.col("kind").isin("user", "assistant"), F.try_variant_get("_v", "$.message.content", kind))
    d = d.withColumn("kind", kind).withColumn("_blocks", F.filter(
        F.transform(content(f"array<{_BLOCK}>"), lambda b, i: F.struct(b["type"].alias("t"), i.alias("i"), b.alias("b"))), lambda x: x["t"].isNotNull()))
    of_type = lambda t: F.filter("_blocks", lambda x: x["t"] == t)
    whole = lambda x: F.get(content("array<variant>"), x["i"])
    string = lambda x, field: only_string(x["b"][field], whole(x), field)
    texts = _join(F.transform(of_type("text"), lambda x: string(x, "text")))
    named = F.transform(of_type("tool_use"), lambda x: F.struct(
        string(x, "id").alias("id"), string(x, "name").alias("name"), F.to_json(x["b"]["input"]).alias("input")))
    calls = F.transform(F.filter(named, lambda c: c["name"].isNotNull()), lambda c: F.struct(
        c["id"].alias("id"), c["name"].alias("name"), F.when(c["input"].startswith("{"), c["input"]).alias("input")))
    flag = lambda x: F.coalesce((x["b"]["is_error"] == "true") & (F.schema_of_variant(_get(whole(x), "is_error")) == "BOOLEAN"), F.lit(False))
    said = lambda x: F.when(~x["b"]["content"].rlike(PLAIN), x["b"]["content"]).otherwise(_flat(_get(whole(x), "content")))
    flat = F.transform(of_type("tool_result"), lambda x: F.struct(
        string(x, "tool_use_id").alias("id"), flag(x).alias("is_error"), said(x).alias("content")))
    results = F.transform(flat, lambda r: F.struct(
        r["id"].alias("id"), r["is_error"].alias("is_error"),
        F.when(r["is_error"], cut(r["content"], ERROR_CHARS)).otherwise(cut(r["content"], OK_CHARS)).alias("content")))
    user, assistant = F.col("kind") == "user", F.col("kind") == "assistant"
    spoken = F.when(F.col("_blocks").isNull(), _text(v, "message.content"))
    none = F.array().cast("array<struct<id:string,is_error:boolean,content:string>>")
    head = lambda field: only_string(h[field], v, field)
    return d.select(
        "session", "pos", "kind", head("sessionId").alias("session_id"),
        F.coalesce(head("timestamp"), F.lit("")).alias("ts"), F.coalesce(head("uuid"), F.lit("")).alias("uuid"),
        F.when(assistant, F.nullif(h["message"]["model"], F.lit(""))).alias("model"),
        F.when(user, F.coalesce(spoken, texts)).when(assistant, texts).alias("text"),
        F.when(assistant, _join(F.transform(of_type("thinking"), lambda x: string(x, "thinking")))).alias("thinking"),
        F.when(assistant, calls).alias("calls"), F.when(user, F.coalesce(results, none)).alias("results"))
