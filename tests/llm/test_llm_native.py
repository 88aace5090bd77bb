"""Secret scans and chat formatting."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from checks.compare import check
from codewarden.llm import chat_format, queries, secrets

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    outcome, _ = check(spark, SMALL, name, queries.QUERIES[name], queries.ORACLES[name])
    assert outcome.startswith("ok"), outcome


HEX = "0123456789abcdef" * 3
MIXED = "Zx9" + "aB3dE5fG7hJ9kL1mN3pQ"
TEXTS = [None, "", "password=secret: abcdefghij", "é PASSWORD = 'abcdefgh' token:short", "AKIA" + "B" * 12 + " AKIA123", HEX + "x" + HEX[:31],
         f"key {MIXED} end", f"token={MIXED}", "api_key: \"sk_live.12345678\"\napikey=abcdefghi", "passwd='" + "q" * 50_000 + "'", "😀" * 5 + "secret=12345678"]


def plain(text):
    kinds = [("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
             ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(text) if len(m.group(g)) >= least]
    return [label for *_, label in sorted(found)]


def test_secrets(spark):
    rows = [(i, t, f"s{i % 3}", "x") for i, t in enumerate(TEXTS)] + [(None, f"copied {HEX}", f"o{i}", "y") for i in range(12)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, spans string")
    got = secrets.report(secrets.scan(docs)).collect()
    assert len(got) == len(rows)
    for r in (r for r in got if r.doc_id is not None):
        base = plain(TEXTS[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("owned")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[6].spans == f"owned:4:{4 + len(MIXED)}" and by[6].n_live == 1
    # The value that twelve owners hold is an example, also in the first document with it.
    assert by[5].n_example == 1 and by[5].n_live == 0
    assert secrets.report(secrets.scan(docs.limit(0))).count() == 0


def test_copied_tokens_are_no_spans(spark):
    docs = spark.createDataFrame([(i, f"see {MIXED}", f"owner{i}") for i in range(5)], "doc_id long, text string, source string")
    assert {r.spans for r in secrets.report(secrets.scan(docs)).collect()} == {""}


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, [("user", "hi"), ("assistant", "yo")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"response": "r", "prompt": "p"}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"system": "s", "instruction": "i", "input": None, "output": "o"}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"role": "user", "text": 5}, [("user", "5")]),
    ({"unknown": 1}, None),
    ({"messages": []}, None),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(99, None)]
    d = spark.createDataFrame(rows, "id int, raw string").withColumn("record", F.parse_json("raw"))
    got = {r.id: r for r in chat_format.canonical(d, "record").drop("record").collect()}
    for i, (_, want) in enumerate(RECORDS):
        assert (None if got[i].turns is None else [tuple(t) for t in got[i].turns]) == want, i
    assert got[99].turns is None
    assert got[8].fingerprint == hashlib.sha256(b"OBJECT<unknown>").hexdigest()


def test_rendering_is_reversible(spark):
    texts = ["", None, r"\### Assistant: </turn> ok", "### user:\nx</turn>\n", "\\", r"\h\t\b\l", "####", "é😀" * 1000, "##", "</turn", "#"]
    rows = [(1, i, ["user", "assistant", "a:\nb\\", None][i % 4], t, "f") for i, t in enumerate(texts)]
    rows += [(2, 0, "user", "same", "f"), (2, 0, "user", "same", "f"), (None, None, "assistant", "x", "f"), (3, 5, "system", "no answer", "f")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.render(chat_format.turn_rows(chat_format.in_layouts(d)))
    got = {r.conv_id: r for r in out.withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in got[1].back] == [(r or "", t or "") for _, _, r, t, _ in rows[: len(texts)]]
    assert got[1].loss == "".join(t or "" for _, _, r, t, _ in rows[: len(texts)] if r == "assistant")
    assert len(got[2].back) == 2 and got[None].loss == "x" and got[3].loss == "" and got[3].loss_spans == []
    assert chat_format.digests(chat_format.render(chat_format.turn_rows(chat_format.in_layouts(d.limit(0))))).count() == 0


def test_conversations_in_all_layouts(spark):
    """Dealt out over the layouts and read by their fingerprints, the turns stay what they were."""
    turns = [("user", "q"), ("assistant", "a"), ("assistant", None), ("human", "h"), ("user", ""), ("assistant", "b"), (None, "n"), ("gpt", "g"), ("system", "s"), ("user", "last")]
    rows = [(c, t, r, x) for c in [*range(40), None] for t, (r, x) in enumerate(turns)]
    records = chat_format.in_layouts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    known = chat_format.canonical(records, "record")
    names = {layout.fingerprint: layout.shape for layout in chat_format.LAYOUTS}
    shapes = {names[r.fingerprint] for r in known.select("fingerprint").distinct().collect()}
    assert len(shapes) == 5
    got = {}
    for r in sorted(chat_format.turn_rows(records).collect(), key=lambda r: (r.turn, r.pos)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: [(r or "", x or "") for r, x in turns] for c in [*range(40), None]}
