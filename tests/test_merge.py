import random
import re

import pytest
from pyspark.sql import functions as F

from codewarden.functions.severity import SEVERITIES
from codewarden.operators import merge
from codewarden.operators.similarity import components

SCHEMA = ("run_id int, ord long, id string, severity string, category string, location string, summary string, detail string, "
          "suggestion string, lenses array<string>, score int, deterministic boolean, model string")


def make(seed, n, files=3, words=6):
    r = random.Random(seed)
    out = []
    for i in range(n):
        f = "hot.ts" if r.random() < 0.5 else f"f{r.randrange(files)}.ts"
        summary = " ".join(r.choice("abcdefgh"[:words]) for _ in range(r.randrange(0, 6)))
        location = f if r.random() < 0.1 else f"{f}:{r.randrange(1, 40)}"
        out.append((r.randrange(2), i, f"x{i}", r.choice(SEVERITIES), f"c{r.randrange(2)}", location, summary, "d" * r.randrange(9),
                    "s" * r.randrange(5), r.sample(["security", "quality", "auth"], r.randrange(1, 3)), r.randrange(100), r.random() < 0.2, f"m{r.randrange(3)}"))
    return out


def rank(s):
    return SEVERITIES.index(s)


def key(s):
    return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", s.lower().strip()))


def jac(a, b, empty):
    return len(a & b) / len(a | b) if a | b else empty


def union(a, b):
    return a + [x for x in b if x not in a]


def brute_review(rows):
    seen = {}
    for r in rows:
        k = (r["run_id"], r["location"].split(":")[0].lower(), r["severity"], key(r["summary"]))
        if k in seen:
            b = seen[k]
            b["lenses"] = union(b["lenses"], r["lenses"])
            if len(r["detail"]) > len(b["detail"]):
                b["detail"] = r["detail"]
        else:
            seen[k] = dict(r)
    items, gone = list(seen.values()), set()
    for i, a in enumerate(items):
        if i in gone:
            continue
        for j in range(i + 1, len(items)):
            b = items[j]
            if j in gone or a["run_id"] != b["run_id"] or a["location"].split(":")[0] != b["location"].split(":")[0]:
                continue
            words = [set(filter(None, key(x["summary"]).split(" "))) for x in (a, b)]
            if abs(rank(a["severity"]) - rank(b["severity"])) <= 1 and jac(*words, 1) > 0.8:
                a["severity"] = min(a["severity"], b["severity"], key=rank)
                a["lenses"] = union(a["lenses"], b["lenses"])
                if len(b["detail"]) > len(a["detail"]):
                    a["detail"] = b["detail"]
                gone.add(j)
    return [x for i, x in enumerate(items) if i not in gone]


def brute_scan(rows):
    def line(r):
        p = r["location"].split(":")
        return int(p[1]) if len(p) > 1 else None

    def absorb(t, s):
        t["severity"] = min(t["severity"], s["severity"], key=rank)
        t["lenses"] = union(t["lenses"], s["lenses"])
        if len(s["detail"]) > len(t["detail"]):
            t["detail"] = s["detail"]
        if len(s["suggestion"]) > len(t["suggestion"]):
            t["suggestion"] = s["suggestion"]
        if s["deterministic"] or t["deterministic"]:
            t["deterministic"], t["score"] = True, 100

    def one_pass(items, meets):
        gone = set()
        for i in range(len(items)):
            if i in gone:
                continue
            a, at = items[i], i
            for j in range(i + 1, len(items)):
                b = items[j]
                if j in gone or a["run_id"] != b["run_id"] or a["location"].split(":")[0] != b["location"].split(":")[0] or not meets(a, b):
                    continue
                if b["deterministic"] and not a["deterministic"]:
                    absorb(b, a)
                    gone.add(at)
                    # The new anchor is settled here, not met again later.
                    a, at = b, j
                    done.add(j)
                else:
                    absorb(a, b)
                    gone.add(j)
            anchors.append(a)
            gone.add(at)
        return gone

    for meets in (lambda a, b: a["category"] == b["category"] and line(a) is not None and line(b) is not None and abs(line(a) - line(b)) <= 5,
                  lambda a, b: set(a["lenses"]) != set(b["lenses"]) and jac(set(re.split(r"\s+", a["summary"].lower())), set(re.split(r"\s+", b["summary"].lower())), 0) >= 0.5):
        anchors, done = [], set()
        one_pass(rows, meets)
        rows = sorted(anchors, key=lambda r: r["ord"])
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_dicts(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return [dict(zip(names, r)) for r in rows]


def view(r):
    return (r["run_id"], r["id"], r["severity"], tuple(r["lenses"]), len(r["detail"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_review_merge_equals_the_greedy_loop(spark, seed):
    rows = make(seed, 90, words=4)
    got = merge.review_dedup(frame(spark, rows).drop("model"), ["run_id"]).collect()
    assert sorted(map(view, (r.asDict() for r in got))) == sorted(map(view, brute_review(as_dicts(rows))))


@pytest.mark.parametrize("seed", [3, 4])
def test_scan_merge_equals_the_greedy_loop(spark, seed):
    rows = make(seed, 70)
    got = merge.scan_dedup(frame(spark, rows).drop("model"), ["run_id"]).collect()
    more = lambda r: (*view(r), r["score"], len(r["suggestion"]))
    assert sorted(map(more, (r.asDict() for r in got))) == sorted(map(more, brute_scan(as_dicts(rows))))


def folded(fold, rows):
    return [fold.add(i, row) for i, row in enumerate(rows)]


def test_deterministic_finding_takes_over_and_later_matches_follow():
    got = folded(merge.line_fold(), [(10, False), (12, True), (15, False), (30, False), (17, True), (9, True)])
    # The base of the first group is row 1, which has the smallest place.
    assert got == [(0, 0), (0, -1), (0, 1), (3, 0), (0, 2), (0, 3)]


def test_wide_severity_gap_blocks_a_merge():
    words = frozenset({"a", "b"})
    assert folded(merge.review_fold(), [(0, words), (4, words), (1, words), (3, words)]) == [(0, 0), (1, 0), (0, 1), (1, 1)]


@pytest.mark.parametrize("fold, row", [(merge.review_fold, (2, frozenset("ab"))), (merge.line_fold, (5, False)),
                                       (merge.domain_fold, (frozenset({"x"}), frozenset("ab"), False))])
def test_a_million_copies_stay_small(fold, row):
    import time

    groups, start = fold(), time.perf_counter()
    for i in range(1_000_000):
        groups.add(i, row)
    assert time.perf_counter() - start < 60 and len(groups.states) == 1 and len(groups.answers) <= 1


def greedy(rows, accepts, absorb):
    """The plain definition: each group in turn walks over all later rows."""
    gone, out = set(), {}
    for i in range(len(rows)):
        if i in gone:
            continue
        state, joined, led, out[i] = rows[i], 0, 0, (i, 0)
        for j in range(i + 1, len(rows)):
            if j in gone or not accepts(state, rows[j]):
                continue
            state, leads = absorb(state, rows[j])
            led, joined = led + leads, joined + (not leads)
            out[j] = (i, -led if leads else joined)
            gone.add(j)
    return [out[i] for i in range(len(rows))]


@pytest.mark.parametrize("seed", range(40))
def test_folds_equal_the_definition(seed):
    r = random.Random(seed)
    some = lambda n: frozenset(r.sample("abcdef", r.randrange(n)))
    cases = [(merge.review_fold, [(r.randrange(5), some(4)) for _ in range(60)]), (merge.line_fold, [(r.randrange(60), r.random() < 0.3) for _ in range(60)]),
             (merge.domain_fold, [(some(3), some(5), r.random() < 0.3) for _ in range(60)])]
    for fold, rows in cases:
        accepts = fold().accepts or (lambda s, x: abs(s[0] - x[0]) <= 5)
        assert folded(fold(), rows) == greedy(rows, accepts, fold().absorb)


def test_vote_unites_earlier_sources(spark):
    rows = make(6, 30, words=3)
    d = frame(spark, rows).withColumn("models", F.array(F.lit("earlier"), F.col("model")))
    for r in merge.vote(d, ["run_id"]).collect():
        assert "earlier" in r.models and r.agreement == len(set(r.models))


def test_vote_groups_are_transitive(spark):
    rows = make(5, 80, words=4)
    got = merge.vote(frame(spark, rows), ["run_id"]).collect()
    items = as_dicts(rows)
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(items):
        for j in range(i + 1, len(items)):
            b = items[j]
            same = a["run_id"] == b["run_id"] and a["location"].split(":")[0] == b["location"].split(":")[0]
            if same and abs(rank(a["severity"]) - rank(b["severity"])) <= 1 and jac(set(a["summary"].split()), set(b["summary"].split()), 1) > 0.7:
                parent[find(i)] = find(j)
    groups = {}
    for i, a in enumerate(items):
        groups.setdefault(find(i), []).append(a)
    want = sorted((g[0]["run_id"], max(g, key=lambda r: (len(r["detail"]), -r["ord"]))["id"], min((r["severity"] for r in g), key=rank),
                   len({r["model"] for r in g}), len(g)) for g in groups.values())
    assert sorted((r.run_id, r.id, r.severity, r.agreement, r.merged_from) for r in got) == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(100, 141)]], "id long")
    got = dict(components(nodes, spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[140] == 140


def test_strategy_filter(spark):
    d = spark.createDataFrame([(1,), (2,), (3,)], "agreement int")
    count = lambda s: merge.by_strategy(d, s, 3).count()
    assert [count(s) for s in ("any", "majority", "unanimous")] == [3, 2, 1]
    assert d.filter(F.col("agreement") > 3).count() == 0
