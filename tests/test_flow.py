from codewarden import session
from codewarden.operators import flow


def build(spark, edges, sources, sinks, flows=(), transforms=()):
    return flow.FlowGraph(
        spark.createDataFrame([("r", f, "src", 1, kind, i) for i, (f, kind) in enumerate(sources)], "repo string, file string, name string, line int, kind string, ord long"),
        spark.createDataFrame([("r", f, n, 2, kind, i) for i, (f, n, kind) in enumerate(sinks)], "repo string, file string, name string, line int, kind string, ord long"),
        spark.createDataFrame([("r", a, b, [s], False, i) for i, (a, b, s) in enumerate(edges)], "repo string, src string, dst string, symbols array<string>, external boolean, ord long"),
        spark.createDataFrame([("r", *t) for t in transforms], "repo string, file string, name string, input string"),
        spark.createDataFrame([("r", p, k, c, "fn", 3, i) for i, (p, k, c) in enumerate(flows)], "repo string, path string, kind string, channel string, function_name string, line int, ord long"))


def rows(df):
    return [(r.source.file, r.sink.file, r.n_hops, r.confidence, r.severity) for r in df.orderBy("rank").collect()]


def test_same_file_is_a_zero_hop_path(spark):
    g = build(spark, [("x", "y", "s")], [("a", "db-query")], [("a", "out", "external-api")])
    assert rows(flow.flow_paths(g)) == [("a", "a", 0, "high", "CRITICAL")]


def test_cycle_ends_and_shortest_path_wins(spark):
    g = build(spark, [("b", "a", "s"), ("c", "b", "s"), ("a", "c", "s")], [("a", "db-query")], [("c", "log", "log")])
    assert rows(flow.flow_paths(g)) == [("a", "c", 1, "high", "HIGH")]


def test_dynamic_channel_is_low_and_transform_is_medium(spark):
    g = build(spark, [("b", "a", "mask")], [("a", "db-query")], [("b", "log", "log"), ("z", "log", "log")],
              [("a", "event-emit", "<dynamic>"), ("z", "event-listen", "<dynamic>")], [("b", "mask", "x")])
    assert sorted(rows(flow.flow_paths(g))) == [("a", "b", 1, "medium", "MEDIUM"), ("a", "z", 1, "low", "LOW")]


def test_depth_bound_and_path_limit(spark):
    chain = [(f"n{i + 1}", f"n{i}", "s") for i in range(7)]
    g = build(spark, chain, [("n0", "db-query")], [(f"n{i}", "log", "log") for i in range(8)])
    assert max(r[2] for r in rows(flow.flow_paths(g))) == 5
    star = build(spark, [(f"s{i}", "a", "s") for i in range(30)], [("a", "db-query")], [(f"s{i}", "log", "log") for i in range(30)])
    assert flow.flow_paths(star).count() == 20 and flow.flow_paths(star, k=100).count() == 30


def hub(spark, sources, sinks):
    """Every source and every sink imports one file; sinks are of three classes, some sources reach a sink directly."""
    n = lambda kind, i: f"{kind}{i:03}.ts"
    src = [("r", n("a", i), f"s{i}", 1, ["file-read", "db-query", "hl7-v2"][i % 3], i) for i in range(sources)]
    snk = [("r", n("z", i), f"k{i}", 2, ["log", "cache", "external-api"][i % 3] if i % 7 else "log", i) for i in range(sinks)]
    pairs = [(n("a", i), "hub.ts") for i in range(sources)] + [("hub.ts", n("z", i)) for i in range(sinks)] + [(n("a", i), n("z", i)) for i in range(0, min(sources, sinks), 5)]
    edges = [("r", a, b, ["x"], False, i) for i, (a, b) in enumerate(pairs)]
    end = "repo string, file string, name string, line int, kind string, ord long"
    return flow.FlowGraph(spark.createDataFrame(src, end), spark.createDataFrame(snk, end),
                          spark.createDataFrame(edges, "repo string, src string, dst string, symbols array<string>, external boolean, ord long"),
                          spark.createDataFrame([], "repo string, file string, name string, input string"),
                          spark.createDataFrame([], "repo string, path string, kind string, channel string, function_name string, line int, ord long"))


def test_a_hub_costs_what_is_reported(spark):
    g, k = hub(spark, 60, 40), 4
    every = [tuple(r) for r in flow.flow_paths(g, k=None).orderBy("rank").collect()]
    assert len(every) == 60 * 40
    assert [tuple(r) for r in flow.flow_paths(g, k=k).orderBy("rank").collect()] == every[:k]
    states = flow.reach(g, k=k)
    assert states.select("origin").distinct().count() <= 2 * k
    assert states.count() < flow.reach(g).count() / 5


def test_sources_and_listeners_meet_where_a_sink_is(spark):
    """Every source publishes, every listener hears it and is called by one of two files with a sink; a second channel leads on."""
    srcs, ears = [f"a{i}" for i in range(12)], [f"l{i:02}" for i in range(30)]
    g = build(spark, [("z0", e, "s") if i % 2 else ("z1", e, "s4") for i, e in enumerate(ears)], [(s, "db-query") for s in srcs],
              [("z0", "log", "log"), ("z1", "log", "log"), ("far", "log", "log")],
              [(s, "event-emit", "c1") for s in srcs] + [(e, "event-listen", "c1") for e in ears]
              + [("z1", "queue-publish", "<dynamic>"), ("far", "queue-subscribe", "<dynamic>")])
    states = {(r.origin, r.node): ([(h.file, h.mechanism) for h in r.hops], r.dynamic) for r in flow.reach(g).collect()}
    assert states.keys() == {(s, z) for s in srcs for z in ("z0", "z1", "far")}
    for s in srcs:
        assert states[s, "z0"] == ([(s, "event-emit"), ("l01", "import")], False)
        assert states[s, "z1"] == ([(s, "event-emit"), ("l00", "import")], False)
        assert states[s, "far"] == ([(s, "event-emit"), ("l00", "import"), ("z1", "queue-publish")], True)


def test_ranked_paths_are_written_without_what_only_orders_them(spark, monkeypatch):
    """Every pair was written with its picks and with the places that its ends have, too."""
    seen, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda d: (seen.append(d.columns), cut(d))[1])
    paths = flow.flow_paths(hub(spark, 6, 4), k=None)
    assert [r.rank for r in paths.orderBy("rank").collect()] == list(range(1, 25))
    pairs = [x for x in seen if "sink" in x]
    assert pairs and not any({"picks", "origin", "node"} & set(x) for x in pairs)
