import hashlib
import zlib

import numpy as np
import pytest

from codewarden.llm import media, queries


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("rows", [1, 2, 33, 200])
def test_every_filter_round_trips(kind, rows):
    raw = np.random.default_rng(rows).integers(0, 256, rows * 64).astype(np.uint8).tobytes()
    assert media.read_png(media.write_png(raw, kind)).tobytes() == raw


def test_rows_with_different_filters():
    raw = np.random.default_rng(5).integers(0, 256, (10, 64)).astype(np.uint8)
    whole = [media.write_png(raw.tobytes(), k) for k in range(5)]
    lines = [np.frombuffer(zlib.decompress(w[w.index(b"IDAT") + 4 : -16]), np.uint8).reshape(10, 65) for w in whole]
    mixed = np.stack([lines[i % 5][i] for i in range(10)])
    head = whole[0][: whole[0].index(b"IDAT") - 4]
    assert (media.read_png(head + media._chunk(b"IDAT", zlib.compress(mixed.tobytes())) + media._chunk(b"IEND", b"")) == raw).all()


def test_damage_is_noticed():
    good = media.write_png(b"a" * 128)
    for bad in (good[:-5], good[:40] + bytes([good[40] ^ 1]) + good[41:], b"x" + good[1:]):
        with pytest.raises(ValueError):
            media.read_png(bad)


def test_hash_is_stable_under_small_changes():
    image = np.random.default_rng(3).integers(0, 256, (80, 64)).astype(np.uint8)
    noisy = image.copy()
    noisy[5, 5] += 9
    bits = lambda b: np.unpackbits(np.frombuffer(b, np.uint8))
    assert (bits(media.phash(image)) != bits(media.phash(noisy))).sum() <= 4
    assert media.phash(image) != media.phash(image[::-1].copy())


def test_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 100, "m"), (2, None, "n"), (3, "", "o"), (None, "a" * 64, "p"), (4, "b" * 1_000_000, "q"), (1, "é" * 100, "m")],
                                 "doc_id long, text string, media string")
    rows = media.media_features(media.media_column(docs)).collect()
    assert len(rows) == 6
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r.media_sha256, bytes(r.phash)) for r in rows if r.doc_id == 1}) == 1
    assert media.media_features(media.media_column(docs.limit(0))).count() == 0


def test_query_unfilters(spark, tmp_path):
    raw = ("some text of several rows " * 20).encode()
    spark.createDataFrame([(1, raw.decode())], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = queries.op5_media_columns(spark, str(tmp_path)).first()
    padded = media.padded(raw)
    assert row.payload_sha256 == hashlib.sha256(padded).hexdigest()
    assert row.media_sha256 == hashlib.sha256(media.write_png(padded, media.UP)).hexdigest()
