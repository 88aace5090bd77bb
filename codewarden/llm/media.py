"""Media columns: lossless grey PNG of a payload, its reader, and a perceptual hash.

The writer stores a byte payload as 8-bit samples, 64 to a row.  The reader
takes any grey 8-bit PNG without interlacing: every chunk's checksum is tested,
the image data are inflated and the five row filters undone with numpy, whole
runs of rows at a time where the filter allows it.  The hash is the sign
pattern of the 8 x 8 lowest frequencies of a cosine transform of the 32 x 32
block means.  Everything is per row, so there is no shuffle; images and hashes
are binary columns.

* null text: empty; it is stored as 64 zero bytes, like an empty text.
* equal texts give equal images and hashes; repeated rows stay repeated.
* the length of a text is known from its own column, so zero bytes at its end
  are not lost.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, steps, texts

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
# Compressed data per IDAT chunk.
_SLICE = 1 << 20


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Whichever of the three is nearest to left + up - corner, in this order on ties."""
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def write_png(payload: bytes, kind: int = NONE, level: int = 6) -> bytes:
    """A PNG with one filter for all rows; text compresses best unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    if kind in (SUB, AVERAGE, PAETH):
        left[:, 1:] = rows[:, :-1]
    if kind in (UP, AVERAGE, PAETH):
        up[1:] = rows[:-1]
    if kind == AVERAGE:
        guess = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    elif kind == PAETH:
        corner[1:, 1:] = rows[:-1, :-1]
        guess = _paeth(left, up, corner)
    else:
        guess = left if kind == SUB else up
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, rows - guess
    packed = zlib.compress(lines.tobytes(), level)
    return b"".join([
        SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)),
        *(_chunk(b"IDAT", packed[a : a + _SLICE]) for a in range(0, len(packed), _SLICE)), _chunk(b"IEND", b"")])


def _unfilter(lines: np.ndarray) -> np.ndarray:
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown row filter")
    cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
    for a, b in zip(cuts, cuts[1:]):
        kind, run = kinds[a], out[a:b]
        above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kind == SUB:
            np.cumsum(run, axis=1, dtype=np.uint8, out=run)
        elif kind == UP:
            run[0] += above
            np.cumsum(run, axis=0, dtype=np.uint8, out=run)
        elif kind in (AVERAGE, PAETH):
            for row in run:
                _unfilter_row(row, above, kind)
                above = row
    return out


def _unfilter_row(row: np.ndarray, above: np.ndarray, kind: int) -> None:
    """Each sample needs the one before it: plain integers, one row."""
    values, up, left, corner = row.tolist(), above.tolist(), 0, 0
    for x, (v, b) in enumerate(zip(values, up)):
        if kind == AVERAGE:
            guess = (left + b) >> 1
        else:
            p, q, r = abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)
            guess = left if p <= q and p <= r else b if q <= r else corner
        values[x] = left = (v + guess) & 255
        corner = b
    row[:] = values


def read_png(stored: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG as (rows, columns); raises ValueError if damaged."""
    if stored[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, shape, data, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(stored):
            raise ValueError("cut off")
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if len(body) != size or stored[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only grey 8-bit images without interlacing")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        elif kind != b"IEND" and not kind[0] & 32:
            raise ValueError(f"unknown chunk {kind!r}")
        ended, at = kind == b"IEND", at + 12 + size
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape or (-1, 1))
    except (zlib.error, ValueError) as err:
        raise ValueError(f"image data: {err}") from None
    return _unfilter(lines)


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(low)[:, None] / (2 * n))


_SIDE, _LOW = 32, 8
_COSINES = _cosines(_SIDE, _LOW)


def _means(image: np.ndarray, axis: int) -> np.ndarray:
    """Means of _SIDE bands along an axis; a short side repeats its lines."""
    n = image.shape[axis]
    first = np.arange(_SIDE) * n // _SIDE
    last = np.maximum((np.arange(_SIDE) + 1) * n // _SIDE, first + 1)
    total = np.concatenate([np.zeros_like(image.take([0], axis)), np.cumsum(image, axis=axis)], axis=axis)
    span = (last - first).reshape((-1, 1) if axis == 0 else (1, -1))
    return (total.take(last, axis) - total.take(first, axis)) / span


def phash(image: np.ndarray) -> bytes:
    """64-bit cosine-transform hash; near images differ in few bits."""
    rows = _means(image.astype(np.float64), 0)
    # Rounded, so that frequencies that are absent count as equal.
    low = np.round(_COSINES @ _means(rows, 1) @ _COSINES.T, 6)
    bits = low.ravel() > np.median(low.ravel()[1:])
    return np.packbits(bits).tobytes()


def media_column(docs: DataFrame, id_col: str = "doc_id", text: str = "text", kind: int = NONE, level: int = 6) -> DataFrame:
    """(doc_id, n_bytes, media binary): every text stored as a PNG."""

    def run(batches):
        for batch in slices(batches):
            media = (write_png(padded(raw), kind, level) for (column,) in steps([batch.select(["_cw_text"])]) for raw in column)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.octet_length(texts(text)).cast("long").alias("n_bytes"), texts(text).alias("_cw_text"))
    return d.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Read a ``media`` column back: payload size and digest, checksum of its last row, hash.

    A damaged image ends the job with its reason; a null image gives nulls.
    """
    kept = [c for c in stored.columns if c != "media"]

    def run(batches):
        for batch in slices(batches):
            found = []
            for (column,) in steps([batch.select(["media"])], 16):
                for media in column:
                    if media is None:
                        found.append((None,) * 6)
                        continue
                    image = read_png(media)
                    payload = image.tobytes()
                    found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
                                  len(media), hashlib.sha256(media).hexdigest(), phash(image)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in kept] + [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], [*kept, *NAMES])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.select(*kept).schema)
    return stored.select(*kept, "media").mapInArrow(run, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary")


NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"]
