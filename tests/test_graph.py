import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, risk


def frame(spark, pairs, nodes=None):
    edges = spark.createDataFrame(pairs, "src string, dst string")
    names = sorted({x for p in pairs for x in p if x} | set(nodes or ()))
    return spark.createDataFrame([(x,) for x in names], "node string"), edges


def rows(df, *columns):
    return {r[0]: r[1] if len(columns) == 1 else tuple(r)[1:] for r in df.select("node", *columns).collect()}


# Five definitions: a class with a base, a method of each, a free function that uses three of them, and a helper.
SIX = [("svc:S", "base:B"), ("svc:S.h", "base:B.h"), ("svc:run", "util:u"), ("svc:run", "svc:S.h"), ("svc:run", "svc:S")]


def test_golden_metrics(spark):
    nodes, edges = frame(spark, SIX)
    deg = rows(graph.degrees(nodes, edges), "ca", "ce_internal", "instability")
    assert deg == {"svc:run": (0, 3, 1.0), "svc:S": (1, 1, 0.5), "svc:S.h": (1, 1, 0.5), "util:u": (1, 0, 0.0), "base:B": (1, 0, 0.0), "base:B.h": (1, 0, 0.0)}
    assert rows(graph.layers(nodes, edges), "layer") == {"svc:run": 0, "svc:S": 1, "svc:S.h": 1, "util:u": 1, "base:B": 2, "base:B.h": 2}
    assert rows(graph.betweenness(nodes, edges), "betweenness") == {"svc:run": 0, "svc:S": 0.05, "svc:S.h": 0.05, "util:u": 0, "base:B": 0, "base:B.h": 0}
    rank = rows(graph.pagerank(nodes, edges), "pagerank")
    assert rank == pytest.approx({"svc:run": 0.11072154, "svc:S": 0.14209264, "svc:S.h": 0.14209264, "util:u": 0.14209264, "base:B": 0.23150028, "base:B.h": 0.23150028}, abs=1e-8)
    out = graph.degrees(nodes, edges)
    for more in (graph.layers(nodes, edges), graph.betweenness(nodes, edges), graph.pagerank(nodes, edges), graph.scc(nodes, edges)):
        out = out.join(more, "node")
    out = out.withColumns({"git_hotness": F.lit(0.0), "self_call": F.lit(False)})
    assert rows(risk.risk_scores(out), "risk") == {"svc:run": 42.78, "svc:S": 56.14, "svc:S.h": 56.14, "util:u": 26.14, "base:B": 30.0, "base:B.h": 30.0}


def test_degenerate_graphs(spark):
    nodes, edges = frame(spark, [], ["a", "b"])
    assert rows(graph.scc(nodes, edges), "scc_id", "scc_size") == {"a": ("a", 1), "b": ("b", 1)}
    assert rows(graph.betweenness(nodes, edges), "betweenness") == {"a": 0, "b": 0}
    assert rows(graph.pagerank(nodes, edges, 3), "pagerank") == {"a": 0.5, "b": 0.5}
    none = nodes.where("false")
    for f in (graph.scc, graph.layers, graph.pagerank, graph.betweenness, graph.degrees):
        assert f(none, edges).count() == 0
    nodes, edges = frame(spark, [("a", "a"), ("a", "b"), ("a", "b"), (None, "b"), ("b", None)])
    assert rows(graph.degrees(nodes, edges), "ca", "ce_internal") == {"a": (0, 1), "b": (1, 0)}
    assert graph.cycles(nodes, edges).count() == 0
    assert rows(graph.layers(nodes, edges), "layer") == {"a": 0, "b": 1}


def plain_reach(pairs, s):
    seen, todo = {s}, [s]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def plain_betweenness(names, pairs):
    import itertools

    def paths(s, t):
        level, seen = [[s]], {s}
        while level:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            nxt = [p + [b] for p in level for a, b in pairs if a == p[-1] and b not in seen]
            seen |= {p[-1] for p in nxt}
            level = nxt
        return []

    out = dict.fromkeys(names, 0.0)
    for s, t in itertools.permutations(names, 2):
        found = paths(s, t)
        for p in found:
            for x in p[1:-1]:
                out[x] += 1 / len(found)
    n = len(names)
    return {x: round(v / ((n - 1) * (n - 2)), 8) for x, v in out.items()}


@pytest.mark.parametrize("by_joins", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_walks_agree_with_plain_ones(spark, monkeypatch, by_joins, seed):
    rng = random.Random(seed)
    names = [f"n{k:02}" for k in range(14)]
    pairs = sorted({(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(20)) if a != b})
    if by_joins:
        monkeypatch.setattr(graph, "TASK_EDGES", 0)
        monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
    nodes, edges = frame(spark, pairs, names)
    reach = {x: plain_reach(pairs, x) for x in names}
    want = {x: min(y for y in names if y in reach[x] and x in reach[y]) for x in names}
    assert rows(graph.scc(nodes, edges), "scc_id") == want
    depth = {c: 0 for c in want.values()}
    for _ in names:
        for a, b in pairs:
            if want[a] != want[b]:
                depth[want[b]] = max(depth[want[b]], depth[want[a]] + 1)
    assert rows(graph.layers(nodes, edges), "layer") == {x: depth[want[x]] for x in names}
    assert rows(graph.betweenness(nodes, edges), "betweenness") == pytest.approx(plain_betweenness(names, pairs), abs=1e-7)
    got = {(r.seed, r.node) for r in graph.reach(edges, nodes.withColumnRenamed("node", "seed")).collect()}
    assert got == {(a, b) for a in names for b in reach[a]}


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(80)]
    nodes, edges = frame(spark, pairs)
    one = [rows(f(nodes.coalesce(1), edges.coalesce(1)), c) for f, c in ((graph.scc, "scc_id"), (graph.pagerank, "pagerank"), (graph.betweenness, "betweenness"))]
    many = [rows(f(nodes.repartition(7), edges.repartition(5)), c) for f, c in ((graph.scc, "scc_id"), (graph.pagerank, "pagerank"), (graph.betweenness, "betweenness"))]
    assert one == many


def test_guard_reach_through_a_cycle(spark):
    _, edges = frame(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("e", "e")])
    guards = spark.createDataFrame([("a", "auth_guard"), ("e", "auth_guard"), ("c", "validation_guard")], "node string, signal string")
    assert rows(graph.guard_reach(edges, guards), "guards") == {"a": "auth_guard", "b": "auth_guard", "c": "auth_guard", "d": "validation_guard"}


def test_paths_and_support(spark):
    edges = spark.createDataFrame([("a", "b", "call", 0.9), ("b", "c", "call", 0.8), ("b", "a", "call", 0.99), ("c", "d", "call", 0.6), ("c", "c", "call", 1.0)], "src string, dst string, kind string, score double")
    got = [(r.node, r.path, r.confidence) for r in graph.two_hop_paths(edges).collect()]
    assert sorted(got) == [("a", "a -> b", 0.9), ("a", "a -> b -> c", 0.8), ("b", "b -> a", 0.99), ("b", "b -> c", 0.8), ("c", "c -> d", 0.6)]
    first = [(r.node, r.direction, r.other) for r in graph.support_edges(edges, 1).collect()]
    assert sorted(first) == [("a", "in", "b"), ("b", "out", "a"), ("c", "in", "c"), ("d", "in", "c")]


def test_layout_and_diff(spark):
    nodes = spark.createDataFrame([("m:a", "m", 0), ("n:b", "n", 2)], "node string, module string, layer int")
    at = rows(risk.layout(nodes), "x", "y", "z")
    assert abs(at["m:a"][0]) <= 1.5 and abs(at["n:b"][0] - 20) <= 1.5 and at["n:b"][2] == -2
    old = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("c", 1.0)], "symbol string, risk double")
    new = spark.createDataFrame([("a", 10.4), ("b", 4.0), ("d", 9.0)], "symbol string, risk double")
    assert {r.symbol: r.status for r in risk.report_diff(old, new).collect()} == {"a": "unchanged", "b": "improved", "c": "resolved", "d": "appeared"}
