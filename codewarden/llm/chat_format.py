"""Chat formatting with layouts selected by schema fingerprint.

Records come in different layouts: single turns, prompt and answer, instruction
with input, lists of messages.  The nested field paths of a record are hashed
to a fingerprint; the fingerprint selects a declarative mapping that yields
canonical (role, text) turns.  Turns are rendered with markers, and the marker
strings inside roles and texts are escaped reversibly, so the rendered text can
be read back exactly.  Only DataFrame functions are used.

* a record whose fingerprint has no mapping keeps null turns and its fingerprint.
* null text or role: empty; a null record: null turns.
* turns of a conversation are ordered by (turn, position in the record, role,
  text); repeated turns stay repeated.
* a conversation is one rendered row, so it has to fit in one; rows that share a conversation's id are one conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = "struct<role: string, text: string>"


@dataclass(frozen=True)
class Messages:
    """A list of messages at ``path``; ``names`` renames roles."""

    path: str
    role: str
    text: str
    names: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Fixed:
    """Turns in a fixed order: (role, paths whose non-empty texts are joined by blank lines)."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class Single:
    """The record is one turn."""

    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """``shape`` lists the nested field paths; see `shape_of`."""

    shape: str
    turns: Messages | Fixed | Single

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.shape.encode()).hexdigest()


LAYOUTS = (
    Layout("OBJECT<role, text>", Single("$.role", "$.text")),
    Layout("OBJECT<messages: ARRAY<OBJECT<content, role>>>", Messages("$.messages", "role", "content")),
    Layout("OBJECT<conversations: ARRAY<OBJECT<from, value>>>",
           Messages("$.conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Layout("OBJECT<completion, prompt>", Fixed((("user", ("$.prompt",)), ("assistant", ("$.completion",))))),
    Layout("OBJECT<prompt, response>", Fixed((("user", ("$.prompt",)), ("assistant", ("$.response",))))),
    Layout("OBJECT<instruction, output>", Fixed((("user", ("$.instruction",)), ("assistant", ("$.output",))))),
    Layout("OBJECT<input, instruction, output>", Fixed((("user", ("$.instruction", "$.input")), ("assistant", ("$.output",))))),
    Layout("OBJECT<input, instruction, output, system>",
           Fixed((("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",))))),
)


def shape_of(record: Column) -> Column:
    """Nested field paths of a variant: its schema in name order, without scalar types."""
    scalar = r"(?!OBJECT<|ARRAY<)[A-Z][A-Z_ ]*(\(\d+,\d+\))?"
    return F.regexp_replace(F.regexp_replace(F.schema_of_variant(record), f": {scalar}", ""), f"ARRAY<{scalar}>", "ARRAY<>")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, rule: Messages | Fixed | Single) -> Column:
    get = lambda path: F.try_variant_get(record, path, "string")
    if isinstance(rule, Single):
        return F.array(_turn(get(rule.role), get(rule.text)))
    if isinstance(rule, Fixed):
        parts = lambda paths: F.filter(F.array(*[get(p) for p in paths]), lambda x: x.isNotNull() & (x != ""))
        return F.array(*[_turn(F.lit(role), F.array_join(parts(paths), "\n\n")) for role, paths in rule.turns])
    rows = F.try_variant_get(record, rule.path, f"array<struct<`{rule.role}`: string, `{rule.text}`: string>>")

    def one(x: Column) -> Column:
        role = x[rule.role]
        for old, new in rule.names.items():
            role = F.when(x[rule.role] == old, F.lit(new)).otherwise(role)
        return _turn(role, x[rule.text])

    return F.transform(rows, one)


def canonical(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``fingerprint`` and ``turns`` (array of role, text) for a variant column."""
    chosen = F.lit(None).cast(f"array<{TURN}>")
    for layout in layouts:
        chosen = F.when(F.col("fingerprint") == layout.fingerprint, _turns(F.col(record), layout.turns)).otherwise(chosen)
    return (records.withColumn("fingerprint", F.sha2(shape_of(F.col(record)).cast("binary"), 256))
            .withColumn("turns", chosen))


# The template.  After escaping no text holds a marker, and every backslash is
# followed by one of the letters below.
OPEN, COLON, CLOSE = "### ", ":\n", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\l"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def render(turns: DataFrame, conv: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_spans) from rows (conv, turn, pos, role, text).

    ``loss_spans`` holds (start, size) in code points of every text that the
    loss counts; offsets are running sums over the rows, not over a list.
    """
    order = Window.partitionBy(conv).orderBy("turn", "pos", "role", "text")
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(COLON))
    rows = (turns.withColumn("_cw_head", head).withColumn("_cw_body", body)
            .withColumn("_cw_i", F.row_number().over(order))
            .withColumn("_cw_size", F.length("_cw_head") + F.length("_cw_body") + len(CLOSE))
            .withColumn("_cw_start", F.coalesce(F.sum("_cw_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("_cw_head")))
    span = F.when(F.col("role") == loss_role, F.struct(F.col("_cw_start").cast("long").alias("start"), F.length("_cw_body").alias("size")))
    parts = F.array_sort(F.collect_list(F.struct("_cw_i", F.concat("_cw_head", "_cw_body", F.lit(CLOSE)).alias("piece"))))
    return rows.groupBy(conv).agg(
        F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a rendered conversation."""
    pieces = F.split(formatted, CLOSE)
    turn = lambda p: F.substring_index(p, COLON, 1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substr(turn(p), F.lit(len(OPEN) + 1)), ROLE_ESCAPES).alias("role"),
        unescape(F.substr(p, F.length(turn(p)) + len(COLON) + 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["size"]))), "")


def in_layouts(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turn, record): turns written in different layouts, dealt out by conversation.

    Some conversations are single turns, some lists of messages under either
    naming; in others a user's turn and the assistant's right after it form a
    prompt with its completion, or an instruction with its output.
    """
    order = Window.partitionBy(conv).orderBy("turn", "role", "text")
    side = lambda shift, role: F.coalesce(F.lag("role", shift).over(order) == role, F.lit(False))
    kind = F.pmod(F.xxhash64(conv), F.lit(5))
    paired = kind >= 3
    is_user, is_assistant = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False))
    own = rows.withColumns({"_cw_leads": paired & is_user & side(-1, "assistant"), "_cw_follows": paired & is_assistant & side(1, "user"),
                            "_cw_next": F.lead("text").over(order)}).filter(~F.col("_cw_follows"))
    variant = lambda **parts: F.to_variant_object(F.struct(*[x.alias(name) for name, x in parts.items()]))
    role, text = F.col("role"), F.col("text")
    named = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    # A role that another layout would rename stays in a layout without renaming.
    free = F.coalesce(~role.isin("human", "gpt"), F.lit(True))
    record = (F.when(F.col("_cw_leads") & (kind == 3), variant(prompt=text, completion=F.col("_cw_next")))
              .when(F.col("_cw_leads"), variant(instruction=text, output=F.col("_cw_next")))
              .when(kind == 1, variant(messages=F.array(F.struct(role.alias("role"), text.alias("content")))))
              .when((kind == 2) & free, variant(conversations=F.array(F.struct(named.alias("from"), text.alias("value")))))
              .otherwise(variant(role=role, text=text)))
    return own.select(conv, "turn", record.alias("record"))


def turn_rows(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of a table of records (conv_id, turn, record), each in a layout of its own."""
    return exploded(canonical(records, "record", layouts), ["conv_id", "turn"])


def exploded(known: DataFrame, keys: list[str]) -> DataFrame:
    """One row per canonical turn; ``pos`` is its place in the record."""
    return (known.select(*keys, F.posexplode("turns").alias("pos", "t"))
            .select(*keys, "pos", F.col("t.role").alias("role"), F.col("t.text").alias("text")))


def digests(rendered: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the rendered text holds, read back from it."""
    back = rendered.withColumn("_cw_turns", read_back(F.col("formatted"))).withColumn("_cw_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    flat = F.array_join(F.transform("_cw_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv, F.size("_cw_turns").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("_cw_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_cw_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
