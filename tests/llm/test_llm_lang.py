import zlib

import numpy as np
import pytest

from codewarden.llm import lang_id, queries
from codewarden.llm.common import table

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return lang_id.fit(table(spark, SMALL, "documents"))


def test_held_out_accuracy(spark, model):
    docs = table(spark, SMALL, "documents").withColumn("held_out", lang_id.held_out())
    rows = lang_id.predict(docs, model).filter("held_out").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark, model):
    german = table(spark, SMALL, "documents").filter("lang = 'de' and n_chars > 2000").orderBy("doc_id").first().text
    rows = [(1, None, "de"), (2, "", "de"), (3, "12 !? 34", "de"), (4, "the and of was with that", None), (5, "the and of was with that", "fr"), (None, german * 300, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in lang_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert got[4].lang_pred == got[5].lang_pred == "en" and got[4].score == got[5].score
    assert got[None].lang_pred == "de" and 0 < got[None].score <= 1
    assert lang_id.predict(docs.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert lang_id.fit(docs) is None
    assert {r.lang_pred for r in lang_id.predict(docs, None).collect()} == {"und"}


def test_sample_is_bounded(spark):
    docs = table(spark, SMALL, "documents")
    windows, labels, languages = lang_id.sample(docs, lang_id.SampleBounds(rows=48, windows=3, least=2))
    n = docs.filter("lang is not null").select("lang").distinct().count()
    assert len(windows) <= 144 and len(languages) == n and set(labels.tolist()) == set(range(n))


def test_every_label_is_learned(spark):
    """Also more labels than the bound of rows has room for."""
    rows = [(i, f"label{i % 90:02} " * 8, f"l{i % 90:02}") for i in range(9000)] + [(9001, "rare word here", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows, labels, languages = lang_id.sample(docs, lang_id.SampleBounds(rows=100, windows=2, least=8))
    count = np.bincount(labels, minlength=91)
    assert len(languages) == 91 and (count[:90] >= 8).all() and (count <= 16).all() and count[90] >= 1


def test_predict_keeps_columns(spark, model):
    docs = spark.createDataFrame([(1, "the and of was", "x", 2)], "doc_id long, text string, lang_pred string, scores int")
    assert lang_id.predict(docs, model).columns == ["doc_id", "text", "scores", "lang_pred", "score"]


def test_language_query(spark):
    rows = {r.doc_id: r for r in queries.op6_language_id(spark, SMALL).collect()}
    want = {r.doc_id: (r.lang, r.text) for r in table(spark, SMALL, "documents").collect()}
    assert rows.keys() == want.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in want[i][1] or "")) for i, r in rows.items())
    right = [r.lang_pred == want[i][0] for i, r in rows.items() if r.held_out and want[i][0]]
    assert np.mean(right) >= 0.97


def test_tables_equal_direct_sums(model):
    x = np.random.default_rng(1).integers(0, 256, (5, lang_id.WINDOW)).astype(np.uint8)
    direct = []
    for p, w in zip(model.bytes_, lang_id.WIDTHS):
        v = sum(p[k][x[:, k : k + lang_id.WINDOW - w + 1]] for k in range(w))
        direct.append(v.max(axis=1))
    want = np.maximum(np.concatenate(direct, axis=1) + model.bias, 0)
    assert np.allclose(lang_id.features(model, model.tables(), x), want, atol=1e-4)
