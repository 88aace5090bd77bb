import contextlib
import io
import random

from pyspark.sql import functions as F

from codewarden.operators import ordered
from codewarden.operators.ordered import neighbour, ordered_union, row_positions, running_sum


def rows(seed=1, n=300):
    r = random.Random(seed)
    # One group holds most of the rows.
    return [("hot" if i % 10 else f"k{i}", i, r.choice([None, 1, 2, 5])) for i in range(n)]


def test_blocks_give_the_same_as_whole_groups(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, pos long, v int")
    s = {(r.k, r.pos): r.s for r in running_sum(df, ["k"], ["pos"], F.coalesce("v", F.lit(0)), "s", size=7).collect()}
    p = {(r.k, r.pos): r.p for r in neighbour(df, ["k"], ["pos"], F.col("v"), "p", size=7).collect()}
    n = {(r.k, r.pos): r.n for r in neighbour(df, ["k"], ["pos"], F.col("v"), "n", forward=True, size=7).collect()}
    assert len(s) == len(p) == len(n) == len(data)
    for k in {d[0] for d in data}:
        group = [d for d in data if d[0] == k]
        total, last = 0, None
        for _, pos, v in group:
            total += v or 0
            assert s[k, pos] == total and p[k, pos] == last
            last = v if v is not None else last
        nxt = None
        for _, pos, v in reversed(group):
            assert n[k, pos] == nxt
            nxt = v if v is not None else nxt


def test_row_positions_are_dense(spark):
    df = spark.createDataFrame(rows(), "k string, pos long, v int")
    got = row_positions(df, ["k"], [F.col("pos")], "n").collect()
    for k in {r.k for r in got}:
        group = sorted((r.pos, r.n) for r in got if r.k == k)
        assert [n for _, n in group] == list(range(1, len(group) + 1))


def test_union_keeps_first_appearance(spark):
    df = spark.createDataFrame([(1, 2, ["b", "c"]), (1, 1, ["c", "a"]), (2, 1, ["z"])], "k int, o int, x array<string>")
    got = {r.k: r.u for r in ordered_union(df, ["k"], F.col("x"), F.col("o"), "u").collect()}
    assert got == {1: ["c", "a", "b"], 2: ["z"]}


def test_neighbour_crosses_blocks_without_a_value(spark):
    """Blocks of rows that have no value keep their rows and hand on what is before or after them."""
    values = {0: "a", 9: "b", 10: None, 19: None, 25: None, 31: "c", 40: None}
    d = spark.createDataFrame([("s", p, v) for p, v in values.items()], "session string, pos long, v string")
    got = {f: {r.pos: r.x for r in neighbour(d, ["session"], ["pos"], F.col("v"), "x", forward=f, size=10).collect()} for f in (False, True)}
    assert got[False] == {0: None, 9: "a", 10: "b", 19: "b", 25: "b", 31: "b", 40: "c"}
    assert got[True] == {0: "b", 9: "c", 10: "c", 19: "c", 25: "c", 31: None, 40: None}


def test_neighbour_passes_the_table_once_for_its_edges(spark):
    d = spark.createDataFrame([("s", 1, "a")], "session string, pos long, v string")
    plan = neighbour(d, ["session"], ["pos"], F.col("v"), "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def test_small_groups_bring_nothing_to_the_join(spark):
    """Sums and neighbours cross borders of blocks only; rows without a group or a position have no place."""
    rows = [("a", 1, 5), ("a", 2, 6), ("b", 1, 7), ("b", 9, 8), (None, 1, 9), ("a", None, 3)]
    d = spark.createDataFrame(rows, "g string, pos int, v int")
    total = running_sum(d, ["g"], ["pos"], F.col("v"), "t", size=4)
    assert sorted((r.g, r.pos, r.t) for r in total.collect()) == [("a", 1, 5), ("a", 2, 11), ("b", 1, 7), ("b", 9, 15)]
    before = neighbour(d, ["g"], ["pos"], F.col("v"), "p", size=4)
    assert sorted((r.g, r.pos, r.p) for r in before.collect()) == [("a", 1, None), ("a", 2, 5), ("b", 1, None), ("b", 9, 7)]
    joins = [x for f in (total, before) for x in f._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and all("LeftOuter" in x for x in joins)


def test_positions_move_rows_once(spark, monkeypatch):
    """Rows went to their group's part of a slice a second time, to be numbered there, with all that only their order needed."""
    df = spark.createDataFrame([(k, i * 7919 % 500, f"x{i}") for k in ("a", "b", None) for i in range(500)], "k string, pos long, x string")
    want = {(k, i, i + 1) for k in ("a", "b") for i in range(500)}
    for few in (1 << 14, 0):  # the offsets are sent to the rows, or the rows to them
        monkeypatch.setattr(ordered, "FEW", few)
        d = row_positions(df.repartition(7), ["k"], [F.col("pos")], "n", without=["x"])
        with contextlib.redirect_stdout(io.StringIO()) as out:
            d.explain()
        assert ("hashpartitioning" in out.getvalue()) == (few == 0)
        assert d.columns == ["k", "pos", "n"] and {tuple(r) for r in d.collect()} == want
