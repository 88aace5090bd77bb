"""Phrase counts and scores against plain loops."""

import collections
import re

import numpy as np
import pytest

from codewarden.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def brute(rows, words, least, covered, top):
    f, size = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^ \t]+", piece)
            size[lang or "und"] += len(ws)
            for n in range(1, words + 1):
                f[lang or "und"].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, of in f.items():
        found = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            if any(100 * b >= covered * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, size[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def texts():
    rng = np.random.default_rng(5)
    words = ["New", "york", "the", "a", "of", "é", "İx", "x|y", "don't", "ОНА", " z", "q-r"]
    weight = np.array([5, 5, 9, 8, 7, 3, 2, 2, 2, 2, 1, 1]) / 47
    rows = []
    for i in range(160):
        body = "".join(str(w) + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b"], p=[0.7, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])) for w in rng.choice(words, int(rng.integers(1, 40)), p=weight))
        rows.append((i, body + "New York city", ["en", "de", None, "und"][i % 4], "x", i))
    rows += [rows[0], (None, "new york " * 300, "en", None, None), (7, None, "en", "", 0), (8, "", None, "", 0), (9, " .\t", "xx", "", 0), (10, "the " * 200_000, "de", "", 0)]
    return rows


@pytest.mark.parametrize("words,shards,bits", [(3, 4, 1 << 16), (3, 1, 64), (4, 3, 1 << 16), (2, 2, 1 << 12)])
def test_by_brute_force(spark, words, shards, bits):
    """Also with filters that pass nearly everything: they never decide."""
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocations.collocations(df, collocations.Counting(words, 5, shards, bits), covered=40, top=30)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, words, 5, 40, 30)


def test_small_accumulators():
    """Counts do not depend on how often a task passes them on."""
    now = np.full(1, np.uint64(2**64 - 1))
    found = []
    for least in (10**9, 50):
        into = collections.Counter()
        a = collocations.Accumulator(b"en", 4, True, now, None)
        for _, text, *_ in [*texts()[:40], (0, None)]:
            if text is None or a.held >= least:
                for _, columns, n in a.counts():
                    for p, k in zip(zip(*(c.tolist() for c in columns)), n.tolist()):
                        into[p] += k
            a.add((text or "").encode())
        found.append(into)
    assert found[0] == found[1] and max(map(len, found[0])) == 4


@pytest.mark.parametrize("bits", [2, 30])
def test_tally(bits):
    """Codes too wide to be packed together are renumbered on the way."""
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << bits, 50)[rng.integers(0, 50, 500)] for _ in range(4)]
    columns = [np.concatenate([c, c[:50]]) for c in columns]
    found, n = collocations._tally(columns, bits)
    want = collections.Counter(zip(*(c.tolist() for c in columns)))
    assert {p: int(k) for p, k in zip(zip(*(c.tolist() for c in found)), n)} == want


def test_numbers_do_not_depend_on_the_place():
    data = b"the cat.sat on  the mat. the cat sat"
    numbers, start, stop, joined = collocations.words_of(data, 5)
    words = [data[a:b] for a, b in zip(start, stop)]
    assert words == [b"the", b"cat", b"sat", b"on", b"the", b"mat", b"the", b"cat", b"sat"]
    assert joined.tolist() == [True, False, True, True, True, False, True, True, False]
    known = dict(zip(words, numbers.tolist()))
    assert len(set(known.values())) == 5 and [known[w] for w in words] == numbers.tolist()
    assert all(len(x) == 0 for x in collocations.words_of(b" . ", 5))


def test_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
