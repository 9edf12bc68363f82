"""Graph metrics over nodes(node) and edges(src, dst).

Edges are a set: repeated pairs count once, and pairs with a null end are no
edges. Ends need not be nodes of the nodes table; metrics are given for the
rows of that table. All results are DataFrames with one row a node.

Two ways serve the metrics that walk the whole graph (components, layers,
betweenness). A graph of at most TASK_EDGES distinct edges, counted first, is
handed to one task, or, for betweenness, broadcast to tasks that each take some
sources. A larger one is worked on by joins, step by step, with every step's
table written to the shared folder.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.workspace import Scratch, ship

#: Edges up to which a graph is given to one task, where an edge takes some 150 bytes.
TASK_EDGES = 2_000_000
#: Edges up to which a graph is broadcast, some 100 bytes each.
BROADCAST_EDGES = 200_000


def edge_set(edges: DataFrame, loops: bool = False) -> DataFrame:
    """Distinct (src, dst) without nulls and, unless loops, without self-loops."""
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    return (edges if loops else edges.where("src <> dst")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """(node, ca, ce_internal, ce_external, ce_total, instability, instability_total).

    ca and ce_internal: distinct neighbours other than the node itself, inwards
    and outwards. ce_external: rows of external(node). Instability is
    ce / (ca + ce), rounded to 4 places, 0 for a node without either.
    """
    pairs = edge_set(edges)
    ends = pairs.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(0).alias("x"))
    ends = ends.unionByName(pairs.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("x")))
    if external is not None:
        ends = ends.unionByName(external.select("node", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("x")))
    sums = ends.groupBy("node").agg(F.sum("i").alias("ca"), F.sum("o").alias("ce_internal"), F.sum("x").alias("ce_external"))
    out = nodes.select("node").distinct().join(sums, "node", "left").na.fill(0, ["ca", "ce_internal", "ce_external"])
    out = out.withColumn("ce_total", F.col("ce_internal") + F.col("ce_external"))

    def share(ce: str):
        both = F.col("ca") + F.col(ce)
        return F.when(both == 0, 0.0).otherwise(F.round(F.col(ce) / F.greatest(both, F.lit(1)), 4))

    return out.withColumn("instability", share("ce_internal")).withColumn("instability_total", share("ce_total"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 30, damping: float = 0.85, places: int = 8, cut: int = 5) -> DataFrame:
    """(node, pagerank) after exactly `rounds` rounds from 1/n; dangling rank spreads evenly, self-loops count.

    A graph of up to TASK_EDGES nodes and edges is ranked in one task, a larger
    one by joins; every `cut` rounds the ranks are then written to the shared
    folder.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "pagerank")
    node = nodes.select("node").distinct()
    out = edge_set(edges, loops=True)
    out = out.join(node.withColumnRenamed("node", "src"), "src", "left_semi").join(node.withColumnRenamed("node", "dst"), "dst", "left_semi")
    out = scratch.table(out, "edges")
    if _small(out) and _small(node):
        found = _in_one_task(node.where("node is not null"), out, lambda n, src, dst: rank_shares(n, src, dst, rounds, damping), "r double")
        return found.select("node", F.round("r", places).alias("pagerank"))
    degree = out.groupBy("src").agg(F.count("*").alias("degree"))
    links = scratch.table(out.join(degree, "src"), "links")
    base = scratch.table(node.join(degree.withColumnRenamed("src", "node"), "node", "left"), "nodes")
    n = base.count()
    if not n:
        return base.select("node", F.lit(0.0).alias("pagerank"))
    ranks = base.withColumn("r", F.lit(1.0 / n))
    for k in range(rounds):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("r"))), F.lit(0.0)).alias("loose"))
        given = links.join(ranks.select(F.col("node").alias("src"), "r"), "src")
        given = given.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") / F.col("degree")).alias("got"))
        step = base.join(given, "node", "left").crossJoin(F.broadcast(loose))  # one row
        r = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        ranks = step.select("node", "degree", r.alias("r"))
        if (k + 1) % cut == 0 and k + 1 < rounds:
            ranks = scratch.table(ranks, f"ranks{k}")
    return ranks.select("node", F.round("r", places).alias("pagerank"))


# Whole-graph walks in one task


def rank_shares(n: int, src: np.ndarray, dst: np.ndarray, rounds: int, damping: float) -> np.ndarray:
    """The rank of each of the nodes 0..n-1 after so many rounds."""
    degree = np.bincount(src, minlength=n)
    rank = np.full(n, 1 / max(n, 1))
    for _ in range(rounds):
        given = np.bincount(dst, rank[src] / degree[src], n)
        rank = (1 - damping) / n + damping * (given + rank[degree == 0].sum() / n)
    return rank


def _adjacent(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in sorted(pairs):
        out[a].append(b)
    return out


def _lists(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[list[int], list[int]]:
    """The targets of the nodes 0..n-1 one after another, ascending, and where each node's begin (n + 1 entries)."""
    order = np.lexsort((dst, src))
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]).tolist(), dst[order].tolist()


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least member of the strongly connected component of each of the nodes 0..n-1: two depth-first passes with explicit stacks."""
    begin, target = _lists(n, src, dst)
    at, seen, order = begin[:n], bytearray(n), []
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = 1
        stack = [start]
        while stack:
            v = stack[-1]
            k, end = at[v], begin[v + 1]
            while k < end and seen[target[k]]:
                k += 1
            if k < end:
                w = target[k]
                at[v] = k + 1
                seen[w] = 1
                stack.append(w)
            else:
                at[v] = k
                order.append(v)
                stack.pop()
    begin, target = _lists(n, dst, src)
    component = [-1] * n
    for start in reversed(order):
        if component[start] >= 0:
            continue
        members, component[start] = [start], start
        for v in members:  # grows
            for w in target[begin[v] : begin[v + 1]]:
                if component[w] < 0:
                    component[w] = start
                    members.append(w)
        least = min(members)
        for v in members:
            component[v] = least
    return np.array(component, np.int64)


def longest_depths(component: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each node the longest path, in components, from a component without predecessors: level by level."""
    n = len(component)
    a, b = component[src], component[dst]
    links = np.unique(a[a != b] * n + b[a != b])
    a, b = links // n, links % n
    begin = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
    left = np.bincount(b, minlength=n)
    depth = np.zeros(n, np.int64)
    frontier = np.flatnonzero((left == 0) & (component == np.arange(n)))
    while len(frontier):
        count = begin[frontier + 1] - begin[frontier]
        at = np.repeat(begin[frontier], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        to = b[at]
        np.maximum.at(depth, to, np.repeat(depth[frontier] + 1, count))
        np.subtract.at(left, to, 1)
        frontier = np.unique(to)
        frontier = frontier[left[frontier] == 0]
    return depth[component]


def shares_of_paths(sources: list[str], ahead: dict[str, list[str]]) -> dict[str, float]:
    """For each node the sum over the sources of the shares of shortest paths that pass through it."""
    out: dict[str, float] = defaultdict(float)
    for s in sources:
        far, count, order, before = {s: 0}, {s: 1.0}, [], defaultdict(list)
        todo = deque([s])
        while todo:
            a = todo.popleft()
            order.append(a)
            for b in ahead.get(a, ()):
                if b not in far:
                    far[b], count[b] = far[a] + 1, 0.0
                    todo.append(b)
                if far[b] == far[a] + 1:
                    count[b] += count[a]
                    before[b].append(a)
        share = dict.fromkeys(order, 0.0)
        for b in reversed(order):
            for a in before[b]:
                share[a] += count[a] / count[b] * (1 + share[b])
            if b != s:
                out[b] += share[b]
    return out


def _in_one_task(nodes: DataFrame, edges: DataFrame, run: Callable[[int, np.ndarray, np.ndarray], np.ndarray], column: str) -> DataFrame:
    """(node, column) by run(nodes, sources, targets) on the nodes' positions by name, in one task; the caller has counted nodes and edges.

    A column of type string is a position's name.
    """
    ship(nodes.sparkSession)
    both = nodes.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges)
    name, kind = column.split(" ")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("src", pa.string()), ("dst", pa.string())]))
        names = pc.unique(pa.chunked_array([*table.column(0).chunks, *table.column(1).drop_null().chunks], pa.string()))
        names = names.take(pc.sort_indices(names))
        if not len(names):
            return
        pairs = table.filter(pc.is_valid(table.column(1)))
        src, dst = (np.asarray(pc.index_in(c, names)).astype(np.int64) for c in pairs.columns)
        out = pa.array(run(len(names), src, dst))
        yield from pa.table({"node": names, name: names.take(out) if kind == "string" else out}).to_batches()

    return both.repartition(1).mapInArrow(task, f"node string, {column}")


def _small(edges: DataFrame, bound: int | None = None) -> bool:
    bound = TASK_EDGES if bound is None else bound
    return edges.limit(bound + 1).count() <= bound


def _linked(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that have an edge, twice as many as edges at most, and the others."""
    linked = pairs.select("src").union(pairs.select("dst")).distinct().toDF("node")
    return linked, nodes.select("node").where("node is not null").distinct().join(linked, "node", "left_anti")


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, scc_id, scc_size): the least member of the strongly connected component, and its size. A lone node is its own."""
    scratch = Scratch(nodes.sparkSession, "scc")
    pairs = scratch.table(edge_set(edges), "edges")
    names = nodes.select("node").union(pairs.select("src")).union(pairs.select("dst")).where("node is not null").distinct()
    if _small(pairs):
        linked, alone = _linked(nodes, pairs)
        found = _in_one_task(linked, pairs, strong_components, "scc_id string").unionByName(alone.withColumn("scc_id", F.col("node")))
    else:
        found = _scc_by_joins(names, pairs, scratch)
    found = scratch.table(found, "found")
    sizes = found.groupBy("scc_id").agg(F.count("*").alias("scc_size"))
    return nodes.select("node").distinct().join(found, "node").join(sizes, "scc_id").select("node", "scc_id", "scc_size")


def _settle(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """labels(node, label) after every node has the least label of those that reach it over links(src, dst)."""
    step = 0
    labels = scratch.table(labels, f"{name}0")
    while True:
        sent = links.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
        new = labels.unionByName(sent).groupBy("node").agg(F.min("label").alias("label"))
        step += 1
        new = scratch.table(new, f"{name}{step}")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def _trim(pairs: DataFrame, scratch: Scratch, name: str, rounds: int = 8) -> DataFrame:
    """pairs without those that no cycle can hold: their start has no predecessor or their end no successor. A few rounds; cycles stay whole."""
    left = pairs.count()
    for k in range(rounds):
        if not left:
            break
        entered, going = pairs.select(F.col("dst").alias("src")).distinct(), pairs.select(F.col("src").alias("dst")).distinct()
        pairs = scratch.table(pairs.join(entered, "src", "left_semi").join(going, "dst", "left_semi").select("src", "dst"), f"{name}-{k}")
        now = pairs.count()
        if now == left:
            break
        left = now
    return pairs


def _scc_by_joins(names: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Trims what lies on no cycle, then colours nodes by the least node that reaches them; what reaches its colour's node back is a component. Repeats on the rest."""
    found, turn = names.where("false").select("node", F.col("node").alias("scc_id")), 0
    while True:
        pairs = _trim(pairs, scratch, f"trim{turn}")
        core = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
        found = found.unionByName(names.join(core, "node", "left_anti").select("node", F.col("node").alias("scc_id")))
        names = scratch.table(core, f"core{turn}")
        if not names.limit(1).count():
            return found
        colours = _settle(names.select("node", F.col("node").alias("label")), pairs, scratch, f"colour{turn}-")
        a, b = colours.select(F.col("node").alias("src"), F.col("label").alias("la")), colours.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
        inner = scratch.table(pairs.join(a, "src").join(b, "dst").where("la = lb").select("src", "dst", F.col("la").alias("label")), f"inner{turn}")
        back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reach = scratch.table(colours.where("node = label"), f"reach{turn}")
        step = 0
        while True:  # breadth first from each colour's node against the edges
            more = back.join(reach.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
            more = scratch.table(more.distinct().join(reach, "node", "left_anti"), f"more{turn}-{step}")
            if not more.limit(1).count():
                break
            reach = scratch.table(reach.unionByName(more), f"reach{turn}-{step}")
            step += 1
        done = reach.select("node", F.col("label").alias("scc_id"))
        found = found.unionByName(done)
        names = scratch.table(names.join(done, "node", "left_anti"), f"names{turn}")
        left = names.select("node")
        pairs = pairs.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
        pairs = scratch.table(pairs.select("src", "dst"), f"edges{turn}")
        turn += 1


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc_id, size, members): components of more than one node, members sorted and joined by commas. Self-loops are no cycles."""
    found = scc(nodes, edges).where("scc_size > 1")
    return found.groupBy("scc_id").agg(F.max("scc_size").alias("size"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer): the longest path, in strongly connected components, from one that nothing depends on."""
    scratch = Scratch(nodes.sparkSession, "layers")
    pairs = scratch.table(edge_set(edges), "edges")
    names = nodes.select("node").union(pairs.select("src")).union(pairs.select("dst")).where("node is not null").distinct()
    if _small(pairs):
        linked, alone = _linked(nodes, pairs)
        found = _in_one_task(linked, pairs, lambda n, src, dst: longest_depths(strong_components(n, src, dst), src, dst), "layer long")
        found = found.unionByName(alone.withColumn("layer", F.lit(0).cast("long")))
        return nodes.select("node").distinct().join(found, "node")
    member = scratch.table(scc(names, pairs).select("node", F.col("scc_id").alias("c")), "member")
    links = pairs.join(member.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(member.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst")
    links = scratch.table(links.where("a <> b").select("a", "b").distinct(), "links")
    depth = scratch.table(member.select("c").distinct().withColumn("layer", F.lit(0).cast("long")), "depth0")
    step = 0
    while True:  # as often as the longest path
        sent = links.join(depth.withColumnRenamed("c", "a"), "a").select(F.col("b").alias("c"), (F.col("layer") + 1).alias("layer"))
        step += 1
        new = scratch.table(depth.unionByName(sent).groupBy("c").agg(F.max("layer").alias("layer")), f"depth{step}")
        changed = new.join(depth.withColumnRenamed("layer", "old"), "c").where("layer <> old").limit(1).count()
        depth = new
        if not changed:
            break
    return nodes.select("node").distinct().join(member, "node").join(depth, "c").select("node", "layer")


def betweenness(nodes: DataFrame, edges: DataFrame, places: int = 8) -> DataFrame:
    """(node, betweenness): exact, directed, unweighted, over (n - 1)(n - 2); 0 with fewer than three nodes."""
    spark = nodes.sparkSession
    scratch = Scratch(spark, "betweenness")
    pairs = scratch.table(edge_set(edges), "edges")
    names = scratch.table(nodes.select("node").distinct(), "nodes")
    n = names.count()
    if n < 3:
        return names.withColumn("betweenness", F.lit(0.0))
    if _small(pairs, BROADCAST_EDGES):
        ship(spark)
        shared = spark.sparkContext.broadcast(_adjacent([(r[0], r[1]) for r in pairs.collect()]))  # at most BROADCAST_EDGES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = shares_of_paths(batch.column(0).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.float64())], ["node", "share"])

        shares = names.repartition("node").mapInArrow(run, "node string, share double")
    else:
        shares = _shares_by_joins(names, pairs, scratch)
    total = shares.groupBy("node").agg(F.sum("share").alias("share"))
    value = F.round(F.coalesce("share", F.lit(0.0)) / ((n - 1) * (n - 2)), places)
    return names.join(total, "node", "left").select("node", value.alias("betweenness"))


def _shares_by_joins(names: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Breadth first from all sources at once, a table a level; then the shares back, level by level."""
    level = names.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths"))
    levels = [scratch.table(level, "level0")]
    seen = levels[0].select("s", "node")
    while True:
        nxt = levels[-1].join(pairs.withColumnRenamed("src", "node"), "node").groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        nxt = scratch.table(nxt.join(seen, ["s", "node"], "left_anti"), f"level{len(levels)}")
        if not nxt.limit(1).count():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select("s", "node"))
    share = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("share"))
    out = []
    for k in range(len(levels) - 1, 0, -1):
        out.append(share.select("node", "share"))
        below = share.select("s", F.col("node").alias("dst"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        got = levels[k - 1].join(pairs.withColumnRenamed("src", "node"), "node").join(below, ["s", "dst"])
        got = got.groupBy("s", "node").agg(F.sum("part").alias("part"))
        share = levels[k - 1].join(got, ["s", "node"], "left").select("s", "node", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share"))
        share = scratch.table(share, f"share{k - 1}")
    frame = out[0] if out else levels[0].select("node", F.lit(0.0).alias("share"))
    for more in out[1:]:
        frame = frame.unionByName(more)
    return frame


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """(seed, node, hops): what each seed(seed) reaches and in how many steps at least, itself with 0.

    Step by step; each step's frontier is what the one before did not hold.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    pairs = scratch.table(edge_set(edges), "edges")
    found = scratch.table(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct(), "found0")
    frontier, step = found, 0
    while hops is None or step < hops:
        step += 1
        more = frontier.join(pairs, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        more = scratch.table(more.join(found, ["seed", "node"], "left_anti").withColumn("hops", F.lit(step)), f"more{step}")
        if not more.limit(1).count():
            break
        found, frontier = found.unionByName(more), more
    return found


def subtype_closure(inherits: DataFrame, types: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """(base, target): each type of types(node, concrete) with its concrete subtypes, itself included if concrete.

    inherits(src, dst): src extends dst. bases(node): the types asked for, where not all are.
    """
    down = inherits.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = types if bases is None else types.join(bases.select("node"), "node", "left_semi")
    found = reach(down, seeds.select(F.col("node").alias("seed")))
    concrete = types.where("concrete").select("node")
    return found.join(concrete, "node", "left_semi").select(F.col("seed").alias("base"), F.col("node").alias("target"))


def guard_reach(edges: DataFrame, guards: DataFrame) -> DataFrame:
    """(node, guards): the guard signals of callers one and two steps back, sorted and comma-joined.

    guards(node, signal). Direct callers are other than the node itself; a
    cycle of two brings a node its own guards.
    """
    pairs = edge_set(edges)
    one = pairs.select(F.col("dst").alias("node"), F.col("src").alias("caller"))
    every = edge_set(edges, loops=True)
    two = one.join(every.select(F.col("dst").alias("caller"), F.col("src").alias("far")), "caller").select("node", F.col("far").alias("caller"))
    callers = one.unionByName(two).distinct()
    found = callers.join(guards.select(F.col("node").alias("caller"), "signal").distinct(), "caller").select("node", "signal").distinct()
    return found.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("signal")), ",").alias("guards"))


def support_edges(edges: DataFrame, limit: int = 3) -> DataFrame:
    """(node, rank, direction, other, kind, score): each node's strongest incident edges, in both directions.

    edges(src, dst, kind, score); order: score descending, incoming first, kind, other end.
    """
    ends = edges.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("other"), "kind", "score")
    ends = ends.unionByName(edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "kind", "score"))
    order = Window.partitionBy("node").orderBy(F.desc("score"), "direction", "kind", "other")
    return ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("node", "rank", "direction", "other", "kind", "score")


def two_hop_paths(edges: DataFrame, least: float = 0.78, limit: int = 3) -> DataFrame:
    """(node, rank, path, hops, confidence): paths of one or two outgoing edges from each node.

    The second edge needs a score of `least`, does not return to the start and
    is no loop; a path's confidence is its least score. Best first: confidence,
    more hops, path.
    """
    one = edges.where("src <> dst").select("src", F.col("dst").alias("mid"), F.col("score").alias("s1"))
    two = edges.where((F.col("src") != F.col("dst")) & (F.col("score") >= least)).select(F.col("src").alias("mid"), F.col("dst").alias("far"), F.col("score").alias("s2"))
    long = one.join(two, "mid").where("far <> src")
    best = Window.partitionBy("src", "mid").orderBy(F.desc("s2"), "far")
    long = long.withColumn("k", F.row_number().over(best)).where("k = 1")
    paths = long.select(F.col("src").alias("node"), F.concat_ws(" -> ", "src", "mid", "far").alias("path"), F.lit(2).alias("hops"), F.least("s1", "s2").alias("confidence"))
    paths = paths.unionByName(one.select(F.col("src").alias("node"), F.concat_ws(" -> ", "src", "mid").alias("path"), F.lit(1).alias("hops"), F.col("s1").alias("confidence")))
    order = Window.partitionBy("node").orderBy(F.desc("confidence"), F.desc("hops"), "path")
    return paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("node", "rank", "path", "hops", "confidence")
