"""The pipeline against the same steps in plain Python, and its stages on odd rows."""

import base64
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from codewarden.llm import lang_id
from codewarden.llm.common import table
from codewarden.llm.shingles import shingles

SMALL = "/root/testdata/sf0.001"


def test_run_equals_plain_steps(spark):
    docs = table(spark, SMALL, "documents")
    net = lang_id.fit(docs)
    rows = docs.collect()
    raw = [(r.text or "").encode() for r in rows]
    good = [r for r, (lang, score) in zip(rows, lang_id.predict_texts(net, net.tables(), raw)) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]
    groups = {}
    for r in good:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", r.text or ""), []).append(r)
    kept = sorted((min(g, key=lambda r: (-len(r.text or ""), r.doc_id)) for g in groups.values()), key=lambda r: r.doc_id)
    sets = [set(shingles(r.text or "").tolist()) for r in kept]
    group = list(range(len(kept)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9:
                group = [group[j] if g == group[i] else g for g in group]
    left = {min(kept[j].doc_id for j, g in enumerate(group) if g == k) for k in set(group)}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: len(library.encode_ordinary(r.text or "")) for r in kept if r.doc_id in left}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SMALL).collect()} == want
    assert 0 < len(want) < len(rows)


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", "a", 0, "x"), (None, "", None, None, None, None), (2, "the and of " * 30_000, "en", "a", 5, "y"), (2, "the and of " * 30_000, "en", "a", 5, "y"),
            (3, "der die das und", "de", "b", 1, "z"), (4, "123", None, "b", 1, "z"), (None, "the was with", "en", None, 1, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_mixed_order_survives_rereading(spark, tmp_path):
    """Part files of unequal size, which a reader deals out by size."""
    rows = [(i, "word " * (i * 37 % 91 + 1) + str(i * i), "en", "abc"[i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = corpus_pipeline.in_mixed_order(spark, docs, SMALL).collect()
    parts = spark.createDataFrame(spark.sparkContext.parallelize(mixed, 12), docs.schema)
    parts.write.option("maxRecordsPerFile", 9).parquet(str(tmp_path / "mixed"))
    again = spark.read.parquet(str(tmp_path / "mixed"))
    order = [r.doc_id for r in mixed]
    assert [r.doc_id for r in again.collect()] != order
    got = sorted(corpus_pipeline.token_digests(spark, again, SMALL).collect(), key=lambda r: r.position)
    assert [r.doc_id for r in got] == order and [r.position for r in got] == list(range(200))
