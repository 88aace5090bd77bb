"""Token counts and byte-level BPE against the libraries, on ordinary and odd texts."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from codewarden.llm import byte_bpe, queries, token_counts

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
ATOMS = ["a", "b", "ab", "the", "'s", "'LL", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\u0085", "<|endoftext|>", "<|startoftext|>",
         "<|ENDOFTEXT|>", "<|", "é", "e\u0301", "Σ", "ΑΣ", "İ", "ß", "ǅ", "1", "23", "½", "²", "!", "...", "中文", "😀", "\u200d", "\ufeff", "\x00", "K", "Å"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(ATOMS, k=r.randint(0, 20))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "The cat's mat", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (None, "no id <|endoftext|>", "z"),
            (4, "word " * 30_000, "long"), (5, " " * 300_000 + "end", "blank"), (6, "x" * 100_000, "run")]
    rows += [(100 + i, t, "odd") for i, t in enumerate(odd_texts(200, 1))]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_counts_equal_the_library():
    library, mine = Tokenizer.from_file(WORDS), token_counts.counter(WORDS)
    texts = odd_texts(4000, 2) + ["abcthe" * 5000, "", "A\nB  C"]
    assert [mine.text(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(token_counts, "KEEP", 5)
    library, mine = Tokenizer.from_file(WORDS), token_counts.Counter(WORDS)
    text = " ".join(f"word{i}" for i in range(100))
    assert mine.text(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(mine) <= 5 and len(mine.words) <= 5


def test_count_query(docs):
    library = Tokenizer.from_file(WORDS)
    rows = token_counts.count_tokens(docs, WORDS).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect()), key=str)
    assert sorted(map(tuple, rows), key=str) == want


def test_pieces_do_not_change_ids():
    codec = byte_bpe.codec(RANKS, P.PATTERN)
    for text in odd_texts(4000, 3):
        ids = [i for part in codec.parts(text, 4) for i in part]
        assert ids == codec.encoding.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_round_trip_query(docs):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.filter("doc_id is null or doc_id <> 5").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids)).encode()), digest((r.text or "").encode())))
    got = {tuple(r) for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    assert set(want) <= got and len(got - set(want)) == 1
    # The library alone overflows its stack on the long run of blanks.
    assert {g[3] for g in got - set(want)} == {digest((" " * 300_000 + "end").encode())}


def test_encode_then_decode(docs):
    tokens = byte_bpe.encode(docs, RANKS, P.PATTERN)
    assert tokens.columns == ["doc_id", "text", "n_tokens", "ids"]
    for r in byte_bpe.decode(tokens, RANKS, P.PATTERN).collect():
        assert bytes(r.decoded) == (r.text or "").encode()


def test_empty_table(docs):
    assert byte_bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(docs.limit(0), WORDS).count() == 0


def test_token_queries(spark):
    """Both queries over a whole table against the libraries."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    library, codec = Tokenizer.from_file(WORDS), byte_bpe.Codec(RANKS, P.PATTERN).encoding
    for r in queries.op7_token_counts(spark, "/root/testdata/sf0.001").collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
    rows = queries.op8_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = codec.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
