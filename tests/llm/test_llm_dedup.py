"""Exact, substring and n-gram deduplication against plain loops."""

import collections
import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from codewarden.llm import exact_dedup, ngram_join, queries, substring_dedup
from codewarden.llm.shingles import shingles

LONG = " ".join(f"w{i}" for i in range(30))
SHORT = "a b\nc d\n" + "\n".join(f"k{i}" for i in range(20))


@pytest.mark.parametrize("bits", [64, 3])
def test_recipes(spark, bits):
    """With three-bit digests nearly every chunk needs a variant number."""
    texts = ["", " ", "a b", "ab", "a\tb", "abc" * 3000, "abc " * 3000, "abd" * 3000, *(f"t{i}" for i in range(40)), "x" * 200_000, "x" * 200_001]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(2, "a b", "again"), (None, "ab", None), (50, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    got = exact_dedup.recipes(docs, digest_bits=bits).collect()
    assert len(got) == len(rows)
    for r in got:
        group = next(g for n, g in groups.items() if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (min(group)[2], len(group))
    assert sum(r.kept for r in got) == len(groups)


def test_chunks_join_up():
    data = b" ".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)) + b"\0" * 60_000
    parts = exact_dedup.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= exact_dedup.MOST
    shifted = exact_dedup.chunks(b"some words before it" * 40 + data)
    assert len(set(parts) & set(shifted)) > 0.8 * len(set(parts))


def test_deduplicate_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "ab", 6), (1, "a b", 5), (2, "c", 7), (3, None, 8), (4, "", 9)], "doc_id long, text string, keep_id int")
    rows = sorted(map(tuple, exact_dedup.deduplicate(docs).collect()), key=str)
    assert rows == [(1, "a b", 5), (2, "c", 7), (3, None, 8)]
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def plain_units(text, least=20):
    """Word tuples and spans of all units, found by trying every run of pieces."""
    pieces, at = [], 0
    for m in [*re.finditer(r"\n|(?<=[.!?])[^\S\n]+\n?", text), None]:
        end = m.end() if m else len(text)
        if words := unicodedata.normalize("NFKC", text[at:end]).casefold().split():
            pieces.append((tuple(words), at, end))
        at = end
    enough = lambda i, j: sum(len(p[0]) for p in pieces[i:j]) >= least
    runs = set()
    for i in range(len(pieces)):
        for j in range(i + 1, len(pieces) + 1):
            if enough(i, j) and (not enough(i, j - 1) or not enough(i + 1, j)):
                runs.add((i, j))
    return [(tuple(p[0] for p in pieces[i:j]), pieces[i][1], pieces[j - 1][2]) for i, j in sorted(runs)]


def test_units_by_trying_all_runs():
    texts = ["", "a", LONG, SHORT, "x. y? z! " * 9, "one two. " * 30, "\n\n".join(["a b c d e f g h i j k. l m"] * 7), "ﬁ ＡＢＣ é. " * 12, "w " * 50 + ". v"]
    every = substring_dedup.units(texts)
    for k, text in enumerate(texts):
        lo, hi, start, end = (x[every[0] == k] for x in every[1:])
        want = plain_units(text)
        assert list(zip(start.tolist(), end.tolist())) == [(a, b) for _, a, b in want]
        assert len(set(zip(lo.tolist(), hi.tolist()))) == len({w for w, *_ in want})
        named = {}
        assert all(named.setdefault(d, w) == w for d, (w, *_) in zip(zip(lo.tolist(), hi.tolist()), want))


def test_rows_of_one_id(spark):
    """Rows without an id, or with the same one, lose what another of them keeps."""
    docs = spark.createDataFrame([(None, LONG + "\nx"), (None, LONG + "\ny"), (7, "a\n" + LONG[1:]), (7, LONG[1:] + "\nb")], "doc_id long, text string")
    left = sorted(r.text for r in substring_dedup.clean(docs).collect())
    assert len(left) == 4 and sum(LONG in t for t in left) == 1 and sum(LONG[1:] in t for t in left) == 2
    texts = docs.select(docs.doc_id.cast("string").alias("doc_id"), "text").unionByName(spark.createDataFrame([("x", LONG)], "doc_id string, text string"))
    assert len(substring_dedup.clean(texts).collect()) == 5


def test_substrings(spark):
    rows = [(1, LONG + "\nx", "p"), (1, LONG + "\nx", "p"), (2, "y\n" + LONG.upper() + "\n" + LONG, "q"), (None, LONG, "r"), (3, None, "s"), (4, "", "t"),
            (5, SHORT, "u"), (6, "zz\n" + SHORT + "\nend", "v"), (7, "\n" * 3000, "w"), (8, "short\nshort", "z"), (9, (LONG + "\n") * 200, "many")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    first = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for words, a, _b in plain_units(t or ""):
            first.setdefault(words, (i, a))
    want = collections.Counter()
    for i, t, _ in rows:
        gone = {c for words, a, b in plain_units(t or "") if first[words] != (i, a) for c in range(a, b)}
        want[i, None if t is None else "".join(c for k, c in enumerate(t) if k not in gone)] += 1
    got = substring_dedup.clean(docs).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[6].text == "zz\nend" and by[6].first_ids == [5] and [tuple(s) for s in by[6].kept] == [(0, 3), (81, 84)]
    assert by[8].text == "short\nshort" and by[1].removed is None and by[9].text == ""
    changed = substring_dedup.clean(docs, changed_only=True).collect()
    assert sorted(map(str, (r.doc_id for r in changed))) == ["2", "6", "9", "None"]
    assert substring_dedup.clean(docs.limit(0)).count() == 0


def near_copies():
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i % 40] + ["edit"] + base[i % 40 :]) if i % 3 else " ".join(base)) for i in range(60)]
    other = [f"u{i}" for i in range(200)]
    rows += [(100 + i, " ".join(other[: 150 + 5 * i])) for i in range(10)]
    rows += [(200, "one"), (201, "One."), (202, None), (203, ""), (204, "..."), (None, " ".join(base)), (205, "a b c d e"), (205, "a b c d e")]
    return rows


@pytest.mark.parametrize("options", [{}, {"limit": 5, "depth": 2, "recall": 0.9999}, {"block": 7}, {"block": 16, "limit": 3, "depth": 1, "recall": 0.9999}])
def test_ngram_join(spark, options):
    rows = near_copies()
    sets = [frozenset(shingles(t or "").tolist()) for _, t in rows]
    alike = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    links = [sum(alike(s, t) for j, t in enumerate(sets) if j != i) for i, s in enumerate(sets)]
    group = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            if alike(s, sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = [min((rows[j][0] for j, g in enumerate(group) if g == group[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, class_id string")
    got = ngram_join.join(docs, **options).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == sorted(((rows[i][0], low[i], links[i]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("options", [{}, {"block": 7}, {"block": 4, "limit": 3, "depth": 1, "recall": 0.9999}])
def test_classes_without_counts(spark, options):
    """Blocks of a few members and chains of neighbours give the classes of the full join."""
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(near_copies())], "doc_id long, text string")
    grouped = lambda df: sorted(map(tuple, df.groupBy("root").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).select("ids").collect()), key=str)
    assert grouped(ngram_join.classes(docs, **options)) == grouped(ngram_join.join(docs, **options))


def test_join_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: frozenset(shingles(r.text or "").tolist()) for r in rows}
    alike = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    near = {i: [j for j, t in sets.items() if j != i and alike(s, t)] for i, s in sets.items()}
    low = {i: i for i in sets}
    for _ in sets:
        low = {i: min([low[i], *(low[j] for j in near[i])]) for i in sets}
    got = queries.op2_ngram_join(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted((i, low[i], len(near[i])) for i in sets)
    assert any(near.values())


def test_representatives(spark):
    docs = spark.createDataFrame([(*r, "c") for r in near_copies()], "doc_id long, text string, class_id string")
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    # The second family is a chain of neighbours above the threshold.
    assert ids == [0, 100, 200, 202, 203, 204, 205]
    assert ngram_join.representatives(docs.limit(0)).count() == 0


def test_runs_follow_the_target():
    assert ngram_join.runs_needed(0.9, 1) < ngram_join.runs_needed(0.99, 1) < ngram_join.runs_needed(0.99, 3)


def test_recall_in_the_deepest_buckets(spark):
    """Pairs at the threshold that meet at the last level only, with the runs of the default recall."""
    n = 1500
    rows = []
    for i in range(n):
        words = [f"p{i}x{k}" for k in range(204)]
        # 200 shingles, and 160 of them: a similarity of 0.8.
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:164]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.join(docs, limit=1).filter("n_links = 1").count() / 2
    # Two deviations of the count below the recall.
    assert found >= n * ngram_join.RECALL - 2 * (n * ngram_join.RECALL * (1 - ngram_join.RECALL)) ** 0.5


def test_passages_inside_a_line(spark):
    """A repeat that begins and ends inside a paragraph goes to both ends; the sentences around it stay."""
    part = " ".join(f"w{i}" for i in range(25)) + ". Short tail! "
    docs = spark.createDataFrame([(1, "One start. " + part + "One end."), (2, "Other start? " + part + "Other end.")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.clean(docs).collect()}
    assert got[1].removed is None and got[2].text == "Other start? Other end." and got[2].first_ids == [1]


def test_query_returns_untouched_documents(spark, tmp_path):
    rows = [(1, LONG), (2, LONG + "\nx"), (3, "short"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[2].removed_chars == len(LONG) + 1 and got[2].first_ids == [1]
    for i, t in rows[:1] + rows[2:]:
        assert tuple(got[i]) == (i, "", 0, len(t or ""), [], hashlib.sha256((t or "").encode()).hexdigest())
