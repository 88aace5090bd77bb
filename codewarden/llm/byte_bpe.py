"""Byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local file and texts are split by the vocabulary's
pattern.  The library recurses on long runs of white space, so texts above
``LONG`` characters are cut first at positions where the pattern always ends a
match; every piece is then encoded on its own and hashed or appended as it
comes, so memory is bounded by one piece.

* null text: empty; empty text: no tokens.
* bytes that are not UTF-8 are encoded as U+FFFD.
* other columns, repeated rows and ids pass through unchanged.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import decoded, slices, steps, texts

#: Characters from which a text is cut before it is encoded.
LONG = 1 << 16
# White space that follows another character: a match of the pattern ends here,
# because a match has at most one white-space character in front of others.
_EDGE = regex.compile(r"(?<=\S)(?=\s)")
# All but the last character of white space before a word are one match.
_BLANKS = regex.compile(r"\s+(?=\s\S)|\s+\Z")


def safe_pieces(text: str, long: int = LONG) -> Iterator[tuple[str, bool]]:
    """(piece, is one match) in order; the pieces are encoded independently."""
    at = 0
    while len(text) - at > long:
        blank = _BLANKS.match(text, at)
        if blank and blank.end() - at > long:
            yield blank.group(), True
            at = blank.end()
            continue
        edge = _EDGE.search(text, at + long)
        end = edge.start() if edge else len(text)
        # A long run of white space inside the piece is cut off by the next round.
        gap = regex.compile(r"(?<=\S)(?=\s{%d})" % (long // 2)).search(text, at + 1, end)
        end = gap.start() if gap else end
        yield text[at:end], False
        at = end
    if at < len(text):
        yield text[at:], False


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.names = {i: str(i) for i in ranks.values()}

    def parts(self, text: str, long: int = LONG) -> Iterator[list[int]]:
        for piece, single in safe_pieces(text, long):
            yield self.encoding._encode_single_piece(piece.encode()) if single else self.encoding.encode_ordinary(piece)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in part]

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes of the ids, whether or not they form valid UTF-8."""
        return self.encoding.decode_bytes(ids)


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of every text as an array column."""
    kept = [c for c in docs.columns if c != out]

    def run(batches):
        c = codec(path, pattern)
        for batch in slices(batches):
            ids = (c.encode(decoded(t)) for cols in steps([batch.select(["_cw_text"])]) for t in cols[0])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(ids, pa.list_(pa.int32()))], [*kept, out])

    d = docs.select(*kept, texts(text).alias("_cw_text"))
    return d.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), f"`{out}` array<int>"]))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that an array of ids stands for; a null array gives no bytes."""
    kept = [c for c in tokens.columns if c != out]

    def run(batches):
        c = codec(path, pattern)
        for batch in slices(batches):
            raw = (c.decode(x or []) for cols in steps([batch.select([ids])]) for x in cols[0])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(raw, pa.binary())], [*kept, out])

    return tokens.select(*kept).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*kept).schema), f"`{out}` binary"]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", kept: tuple[str, ...] = ()) -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the decoded bytes, and the columns ``kept``.

    Ids and bytes of a text are consumed piece by piece and never leave the task.
    """

    def run(batches):
        c = codec(path, pattern)
        for batch in slices(batches):
            counts, ids_hex, raw_hex = [], [], []
            for (column,) in steps([batch.select(["_cw_text"])]):
                for raw in column:
                    n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in c.parts(decoded(raw)):
                        if ids:
                            a.update(((" " if n else "") + " ".join(map(c.names.__getitem__, ids))).encode())
                            b.update(c.decode(ids))
                            n += len(ids)
                    counts.append(n)
                    ids_hex.append(a.hexdigest())
                    raw_hex.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(raw_hex, pa.string()),
                 *(batch.column(k) for k in kept)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *kept])

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), texts(text).alias("_cw_text"), *kept)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return d.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
