import collections
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from codewarden.llm import mixing, queries

SMALL = "/root/testdata/sf0.001"


def plain(blocks, weights):
    """(source, block) -> (phase, slot): in every slot the released block with the earliest deadline, ties by name."""
    out, left, done, at, phase = {}, {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, 0
    while left:
        now = {s: Fraction(weights[s]) for s in left if weights.get(s, 0) > 0} or {s: Fraction(blocks[s]) for s in left}
        total, count, t = sum(now.values()), dict.fromkeys(now, 0), 0
        while all(count[s] < left[s] for s in now):
            released = [s for s in now if math.floor(count[s] * total / now[s]) <= t]
            s = min(released, key=lambda s: (math.ceil((count[s] + 1) * total / now[s]), s))
            out[s, done[s] + count[s]] = (phase, at + t)
            count[s] += 1
            t += 1
        for s in now:
            done[s] += count[s]
            left[s] -= count[s]
        left, at, phase = {s: n for s, n in left.items() if n}, at + t, phase + 1
    return out


def listed(rows):
    return {(s, i): (phase, at + slots[i - a]) for s, phase, a, b, at, _, slots in rows for i in range(a, b)}


@pytest.mark.parametrize("weights", [{"a": 5, "b": 1, "c": 0.3, "d": 0.001}, {"a": 1}, {f"s{i}": i + 1 for i in range(30)}, {"a": 0.1, "b": 0}])
def test_phases_follow_a_plain_loop(weights):
    blocks = {**{s: 7 + 40 * (i % 3) for i, s in enumerate(weights)}, "other": 9, "": 5, "none": 0}
    got = listed(mixing.phases(blocks, weights))
    assert got == plain(blocks, weights)
    assert sorted(t for _, t in got.values()) == list(range(sum(blocks.values())))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "t" * (i % 50 + 1), "abc"[i % 2 + (i % 7 == 0)], i) for i in range(500)]
    rows += [(None, None, None, 1), (None, None, None, 1), (900, "", "", 2), (901, "z" * 5000, "c", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot long")


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_places_follow_a_plain_loop(docs, most):
    """Blocks of 100 characters, longer ones where the corpus would have more than ``most``."""
    rows = mixing.located(docs, weights={"a": 3, "b": 1, "c": 1}, block=100, most=most).collect()
    assert len(rows) == docs.count()
    ends, all_chars = {}, 0
    for s in ("a", "b", "c", ""):
        own = sorted({(r.offset, r.doc_id, max(len(r.text or ""), 1)) for r in rows if (r.source or "") == s}, key=lambda x: x[0])
        at = 0
        for offset, doc_id, n in own:
            assert offset == at
            at += n * (2 if doc_id is None else 1)
        all_chars += at
        ends[s] = at
    block = max(100, -(-all_chars // most))
    place = plain({s: (n - 1) // block + 1 for s, n in ends.items()}, {"a": 3, "b": 1, "c": 1})
    for r in rows:
        assert r.block == r.offset // block and (r.phase, r.slot) == place[r.source or "", r.block]


def test_mix_query(spark):
    """The whole query against sums and slots worked out row by row."""
    rows = queries.op3_source_mix(spark, SMALL).collect()
    size = {r.doc_id: (r.source or "", max(len(r.text or ""), 1)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(size)
    total = collections.Counter()
    for r in sorted(rows, key=lambda r: r.offset):
        s, n = size[r.doc_id]
        assert r.offset == total[s]
        total[s] += n
    place = plain({s: (n - 1) // mixing.BLOCK + 1 for s, n in total.items()}, {s: n**0.5 for s, n in total.items()})
    assert all((r.phase, r.slot) == place[r.source or "", r.block] and r.block == r.offset // mixing.BLOCK for r in rows)


def test_interleaved_keeps_rows_and_columns(docs):
    out = mixing.interleaved(docs, block=100)
    assert out.columns == docs.columns
    order = [(r.doc_id, r.source) for r in out.collect()]
    assert sorted(order, key=str) == sorted(((r.doc_id, r.source) for r in docs.collect()), key=str)
    place = {r.doc_id: (r.slot, r.offset) for r in mixing.located(docs, block=100).collect()}
    assert [place[i] for i, _ in order] == sorted(place[i] for i, _ in order)
    named = docs.withColumnsRenamed({"slot": "_cw_slot2"}).withColumns({"phase": F.lit("p"), "block": F.lit(1)})
    assert mixing.interleaved(named, block=100).columns == named.columns
    assert mixing.interleaved(docs.limit(0)).count() == 0 and mixing.located(docs.limit(0)).count() == 0


def test_exact_weights_are_followed():
    """Less than a block away from the given weights themselves, however many slots there are."""
    weights = {"a": 2**0.5, "b": 3**0.5, "c": 0.3, "tiny": 0.0001, **{f"s{i}": (i + 1) ** 0.5 / 50 for i in range(20)}}
    total = sum(map(Fraction, weights.values()))
    rows = mixing.phases(dict.fromkeys(weights, 20_000), weights)
    assert max(len(r[-1]) for r in rows) <= mixing.PIECE
    owner = {at + slots[i - a]: s for s, phase, a, b, at, _, slots in rows for i in range(a, b) if phase == 0}
    assert sorted(owner) == list(range(len(owner))) and len(owner) > 20_000
    count = collections.Counter()
    for t in range(len(owner)):
        count[owner[t]] += 1
        if t % 97 == 0 or t == len(owner) - 1:
            assert all(abs(count[s] - w * (t + 1) / total) < 1 for s, w in zip(weights, map(Fraction, weights.values())))
