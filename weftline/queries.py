"""Queries over the driver's tables, one an operator, with their SQL.

Graphs made from the tables (all rows of them):

* G1, acyclic: customer -> nation, supplier -> nation, nation -> region, part -> supplier,
* G2, nations: customer's nation -> supplier's nation by line count, the first three targets of each source,
* G4, users: a user -> the user of the next event of the same type and day, without self-pairs; the first one or two targets by count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import contract, evidence, graph, intervals, resolve, retrieve, risk, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


# Graphs


def g1_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select(_id("c", "c_custkey").alias("src"), _id("n", "c_nationkey").alias("dst"))
    s = _t(spark, sf, "supplier").select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst"))
    n = _t(spark, sf, "nation").select(_id("n", "n_nationkey").alias("src"), _id("r", "n_regionkey").alias("dst"))
    p = _t(spark, sf, "lineitem").select(_id("p", "l_partkey").alias("src"), _id("s", "l_suppkey").alias("dst")).distinct()
    return c.unionByName(s).unionByName(n).unionByName(p)


def _nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


G1 = """
g1 AS (
  SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem),
v1 AS (SELECT src AS node FROM g1 UNION SELECT dst FROM g1)"""


def g2_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, lines, rank); rank 1 to 3."""
    line = _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    order = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    cust = _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    supp = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    pairs = line.join(order, "l_orderkey").join(cust, "c_custkey").join(supp, "l_suppkey")
    pairs = pairs.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("lines"))
    first = Window.partitionBy("c_nationkey").orderBy(F.desc("lines"), "s_nationkey")
    pairs = pairs.withColumn("rank", F.row_number().over(first)).where("rank <= 3")
    return pairs.select(_id("n", "c_nationkey").alias("src"), _id("n", "s_nationkey").alias("dst"), "lines", "rank")


G2 = """
g2 AS (
  SELECT 'n:' || a AS src, 'n:' || b AS dst, lines, rank FROM (
    SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS lines,
           row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, s_nationkey) AS rank
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY 1, 2) WHERE rank <= 3),
v2 AS (SELECT 'n:' || n_nationkey AS node, 'r:' || n_regionkey AS module FROM nation)"""


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").select(_id("n", "n_nationkey").alias("node"), _id("r", "n_regionkey").alias("module"))


def g4_edges(spark: SparkSession, sf: str, top: int) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    nxt = F.lead("user_id").over(Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id"))
    pairs = e.withColumn("next", nxt).where("next is not null and next <> user_id").groupBy("user_id", "next").agg(F.count("*").alias("n"))
    first = Window.partitionBy("user_id").orderBy(F.desc("n"), "next")
    pairs = pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return pairs.select(_id("u", "user_id").alias("src"), _id("u", "next").alias("dst"))


def _g4(top: int) -> str:
    return f"""
g4 AS (
  SELECT 'u:' || user_id AS src, 'u:' || next AS dst FROM (
    SELECT user_id, next, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, next) AS rank
    FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS next FROM events)
    WHERE next IS NOT NULL AND next <> user_id GROUP BY user_id, next) WHERE rank <= {top}),
v4 AS (SELECT src AS node FROM g4 UNION SELECT dst FROM g4)"""


_DEGREES = """
SELECT node, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce_internal, {x} AS ce_external, coalesce(ce, 0) + {x} AS ce_total,
  CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0.0 ELSE round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)), 4) END AS instability,
  CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) + {x} = 0 THEN 0.0 ELSE round((coalesce(ce, 0) + {x}) / (coalesce(ca, 0) + coalesce(ce, 0) + {x}), 4) END AS instability_total
FROM {v} LEFT JOIN (SELECT dst AS node, count(DISTINCT src) AS ca FROM {g} WHERE src <> dst GROUP BY 1) USING (node)
LEFT JOIN (SELECT src AS node, count(DISTINCT dst) AS ce FROM {g} WHERE src <> dst GROUP BY 1) USING (node) {more}"""


@query(f"WITH {G1}, x AS (SELECT 'c:' || o_custkey AS node, count(*) AS x FROM orders GROUP BY 1) " + _DEGREES.format(v="v1", g="g1", x="coalesce(x, 0)", more="LEFT JOIN x USING (node)"))
def degrees(spark, sf):
    edges = g1_edges(spark, sf)
    return graph.degrees(_nodes_of(edges), edges, _t(spark, sf, "orders").select(_id("c", "o_custkey").alias("node")))


def _pagerank_sql(rounds: int) -> str:
    return f"""WITH RECURSIVE {G2}, deg AS (SELECT src, count(*) AS d FROM g2 GROUP BY 1), n AS (SELECT count(*) AS n FROM v2),
names AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM v2),
gives AS (SELECT a.i AS i, list([b.i, d] ORDER BY b.i) AS links FROM g2 JOIN names a ON a.node = src JOIN names b ON b.node = dst JOIN deg USING (src) GROUP BY a.i),
ranked AS (SELECT 0 AS k, list(CAST(1.0 / n AS DOUBLE) ORDER BY i) AS r FROM names, n
  UNION ALL SELECT k + 1, (SELECT list(CAST(0.15 / n + 0.85 * (coalesce(got, 0) + loose / n) AS DOUBLE) ORDER BY names.i) FROM names, n,
      (SELECT coalesce(sum(r[names.i]), 0) AS loose FROM names WHERE names.i NOT IN (SELECT i FROM gives))
      LEFT JOIN (SELECT link[1] AS i, sum(share) AS got FROM (SELECT unnest(links) AS link, r[gives.i] / len(links) AS share FROM gives) GROUP BY 1) g ON g.i = names.i)
    FROM ranked WHERE k < {rounds})
SELECT node, round(r[i], 8) AS pagerank FROM names, ranked WHERE k = {rounds}"""


@query(_pagerank_sql(30))
def pagerank(spark, sf):
    return graph.pagerank(_nations(spark, sf), g2_edges(spark, sf))


@query(f"""WITH {G2},
m AS (SELECT DISTINCT a.module AS ma, b.module AS mb FROM g2 JOIN v2 a ON a.node = src JOIN v2 b ON b.node = dst WHERE a.module <> b.module),
u AS (SELECT module, count(*) AS n_nodes FROM v2 GROUP BY 1),
j AS (SELECT u.module, n_nodes, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM u
  LEFT JOIN (SELECT mb AS module, count(*) AS ca FROM m GROUP BY 1) USING (module) LEFT JOIN (SELECT ma AS module, count(*) AS ce FROM m GROUP BY 1) USING (module)),
k AS (SELECT *, CASE WHEN ca + ce = 0 THEN 0.0 ELSE round(ce / (ca + ce), 4) END AS instability FROM j)
SELECT *, round((0.6 * instability + 0.4 * ca / (SELECT CASE WHEN max(ca) = 0 THEN 1 ELSE max(ca) END FROM k)) * 100, 2) AS risk FROM k""")
def module_rollup(spark, sf):
    return risk.module_rollup(_nations(spark, sf), g2_edges(spark, sf))


_REACH4 = "rc AS (SELECT src AS a, dst AS b FROM g4 UNION SELECT rc.a, g4.dst FROM rc JOIN g4 ON rc.b = g4.src)"


@query(f"""WITH RECURSIVE {_g4(1)}, {_REACH4},
s AS (SELECT v4.node, least(v4.node, coalesce(min(r1.b), v4.node)) AS scc_id FROM v4
  LEFT JOIN (SELECT x.a, x.b FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a) r1 ON r1.a = v4.node GROUP BY v4.node)
SELECT node, scc_id, count(*) OVER (PARTITION BY scc_id) AS scc_size FROM s""")
def scc(spark, sf):
    edges = g4_edges(spark, sf, 1)
    return graph.scc(_nodes_of(edges), edges)


@query(f"""WITH RECURSIVE {_g4(1)}, {_REACH4},
s AS (SELECT x.a AS node, min(x.b) AS low FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
t AS (SELECT node, least(node, low) AS scc_id FROM s)
SELECT scc_id, count(*) AS size, string_agg(node, ',' ORDER BY node) AS members FROM t GROUP BY scc_id HAVING count(*) > 1""")
def cycles(spark, sf):
    edges = g4_edges(spark, sf, 1)
    return graph.cycles(_nodes_of(edges), edges)


@query(f"""WITH RECURSIVE {G1},
d AS (SELECT node, 0 AS layer FROM v1 UNION SELECT g1.dst, d.layer + 1 FROM d JOIN g1 ON d.node = g1.src)
SELECT node, max(layer) AS layer FROM d GROUP BY node""")
def layers(spark, sf):
    edges = g1_edges(spark, sf)
    return graph.layers(_nodes_of(edges), edges)


@query(f"""WITH RECURSIVE {G2}, e AS (SELECT src, dst FROM g2 WHERE src <> dst),
w AS (SELECT node AS s, node AS t, 0 AS d FROM v2 UNION SELECT w.s, e.dst, w.d + 1 FROM w JOIN e ON w.t = e.src WHERE w.d < 24),
dist AS (SELECT s, t, min(d) AS d FROM w GROUP BY 1, 2),
p AS (SELECT node AS s, node AS t, 0 AS d, node AS trail FROM v2
  UNION ALL SELECT p.s, e.dst, p.d + 1, p.trail || '>' || e.dst FROM p JOIN e ON p.t = e.src JOIN dist ON dist.s = p.s AND dist.t = e.dst AND dist.d = p.d + 1),
c AS (SELECT s, t, d, count(*) AS n FROM p GROUP BY 1, 2, 3),
b AS (SELECT x.t AS node, sum(x.n * y.n / z.n) AS share FROM c x JOIN c y ON x.t = y.s JOIN c z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d
  WHERE x.s <> x.t AND y.s <> y.t AND x.s <> y.t GROUP BY 1)
SELECT node, round(coalesce(share, 0) / ((SELECT count(*) FROM v2) - 1) / ((SELECT count(*) FROM v2) - 2), 6) AS betweenness FROM v2 LEFT JOIN b USING (node)""")
def betweenness(spark, sf):
    return graph.betweenness(_nations(spark, sf), g2_edges(spark, sf), places=6)


@query(f"""WITH RECURSIVE {_g4(1)},
r AS (SELECT node AS seed, node, 0 AS hops FROM v4 UNION SELECT seed, g4.dst, hops + 1 FROM r JOIN g4 ON r.node = g4.src WHERE hops < 6)
SELECT seed, node, min(hops) AS hops FROM r GROUP BY seed, node""")
def reach_within_6(spark, sf):
    edges = g4_edges(spark, sf, 1)
    return graph.reach(edges, _nodes_of(edges).withColumnRenamed("node", "seed"), hops=6)


@query("""WITH RECURSIVE i AS (
  SELECT 's:' || s_suppkey AS src, 'n:' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation),
t AS (SELECT 's:' || s_suppkey AS node, true AS concrete FROM supplier UNION ALL SELECT 'n:' || n_nationkey, false FROM nation UNION ALL SELECT 'r:' || r_regionkey, false FROM region),
c AS (SELECT node AS base, node AS target FROM t UNION SELECT c.base, i.src FROM c JOIN i ON c.target = i.dst)
SELECT base, target FROM c JOIN t ON t.node = c.target WHERE concrete""")
def subtype_closure(spark, sf):
    s, n, r = (_t(spark, sf, x) for x in ("supplier", "nation", "region"))
    up = s.select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst"))
    up = up.unionByName(n.select(_id("n", "n_nationkey").alias("src"), _id("r", "n_regionkey").alias("dst")))
    types = s.select(_id("s", "s_suppkey").alias("node"), F.lit(True).alias("concrete"))
    types = types.unionByName(n.select(_id("n", "n_nationkey").alias("node"), F.lit(False).alias("concrete"))).unionByName(r.select(_id("r", "r_regionkey").alias("node"), F.lit(False).alias("concrete")))
    return graph.subtype_closure(up, types)


_SIGNAL_OF = {"click": "input_boundary", "error": "deserialization", "purchase": "database_io", "signup": "state_mutation", "view": "network_io"}
_CASE_SIGNAL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SIGNAL_OF.items()) + " END"


def _guards(spark, sf):
    e = _t(spark, sf, "events").where("event_type in ('error', 'signup') and value < 3")
    return e.select(_id("u", "user_id").alias("node"), F.when(F.col("event_type") == "error", "error_handling").otherwise("auth_guard").alias("signal")).distinct()


_GUARDS = "gu AS (SELECT DISTINCT 'u:' || user_id AS node, CASE WHEN event_type = 'error' THEN 'error_handling' ELSE 'auth_guard' END AS signal FROM events WHERE event_type IN ('error', 'signup') AND value < 3)"
_GUARD_REACH = """
w AS (SELECT dst AS node, src AS caller FROM g4 WHERE src <> dst
  UNION SELECT a.dst, b.src FROM g4 a JOIN g4 b ON b.dst = a.src WHERE a.src <> a.dst),
gr AS (SELECT node, string_agg(signal, ',' ORDER BY signal) AS guards FROM (SELECT DISTINCT w.node, signal FROM w JOIN gu ON gu.node = w.caller) GROUP BY node)"""


@query(f"WITH {_g4(2)}, {_GUARDS}, {_GUARD_REACH} SELECT node, guards FROM gr")
def guard_reach(spark, sf):
    return graph.guard_reach(g4_edges(spark, sf, 2), _guards(spark, sf))


def _user_signals(spark, sf):
    e = _t(spark, sf, "events").where("value > 20")
    signal = F.create_map(*(F.lit(x) for k, v in _SIGNAL_OF.items() for x in (k, v)))[F.col("event_type")]
    return e.select(_id("u", "user_id").alias("node"), signal.alias("signal")).groupBy("node").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


_RULE_CASES = " UNION ALL ".join(
    f"SELECT node, '{rule}' AS rule, '{severity}' AS severity FROM u WHERE {test}"
    for rule, severity, test in (
        ("unguarded_entry", "critical", "list_contains(s, 'input_boundary') AND NOT list_contains(a, 'auth_guard') AND NOT list_contains(a, 'validation_guard')"),
        ("untrusted_deserialization", "critical", "list_contains(s, 'deserialization') AND NOT list_contains(a, 'validation_guard')"),
        ("concurrent_mutation", "high", "list_contains(s, 'concurrency') AND list_contains(s, 'state_mutation') AND NOT list_contains(s, 'error_handling')"),
        ("cache_coherence_risk", "high", "list_contains(s, 'caching') AND list_contains(s, 'state_mutation') AND list_contains(s, 'concurrency')"),
        ("open_network_call", "high", "list_contains(s, 'network_io') AND NOT list_contains(a, 'error_handling')"),
        ("unguarded_db_write", "high", "list_contains(s, 'database_io') AND list_contains(s, 'state_mutation') AND NOT list_contains(a, 'auth_guard')"),
        ("double_indirection", "medium", "list_contains(s, 'orm_dynamic_load') AND list_contains(s, 'dynamic_dispatch')"),
        ("stateful_input_boundary", "medium", "list_contains(s, 'input_boundary') AND list_contains(s, 'state_mutation') AND NOT list_contains(s, 'validation_guard')"),
    )
)


@query(f"""WITH {_g4(2)}, {_GUARDS}, {_GUARD_REACH},
o AS (SELECT 'u:' || user_id AS node, list(DISTINCT {_CASE_SIGNAL}) AS s FROM events WHERE value > 20 GROUP BY 1),
u AS (SELECT node, s, list_concat(s, string_split(coalesce(guards, ''), ',')) AS a FROM o LEFT JOIN gr USING (node)) {_RULE_CASES}""")
def arch_rules(spark, sf):
    reachable = guard_reach(spark, sf).select("node", F.split("guards", ",").alias("reachable"))
    return signals.arch_rules(_user_signals(spark, sf).join(reachable, "node", "left"))


# Risk


def _measured(spark, sf):
    """Users of G4 with degrees, component, and metrics made from their events."""
    edges = g4_edges(spark, sf, 2)
    e = _t(spark, sf, "events").groupBy(_id("u", "user_id").alias("node"))
    e = e.agg(F.count("*").alias("n"), F.max("event_id").alias("m"), F.count_distinct("event_type").alias("k"))
    out = graph.degrees(_nodes_of(edges), edges).drop("ce_external").join(e, "node")
    return out.select(
        "node", "ca", "ce_internal", F.col("k").alias("ce_external"), "ce_total", "instability",
        (F.col("n") / 1000).alias("pagerank"), (F.col("m") % 97 / 1000).alias("betweenness"), (F.col("m") % 10 / 10).alias("git_hotness"),
        (1 + F.col("m") % 3).alias("scc_size"), (F.col("m") % 7 == 0).alias("self_call"), (F.col("m") % 4).alias("layer"), (F.col("m") % 5 == 0).cast("int").alias("n_bases"),
    )


_MEASURED = f"""{_g4(2)}, dg AS ({_DEGREES.format(v="v4", g="g4", x="0", more="")}),
e AS (SELECT 'u:' || user_id AS node, count(*) AS n, max(event_id) AS m, count(DISTINCT event_type) AS k FROM events GROUP BY 1),
me AS (SELECT node, ca, ce_internal, k AS ce_external, ce_total, instability, n / 1000 AS pagerank, m % 97 / 1000 AS betweenness, m % 10 / 10 AS git_hotness,
  1 + m % 3 AS scc_size, m % 7 = 0 AS self_call, m % 4 AS layer, CASE WHEN m % 5 = 0 THEN 1 ELSE 0 END AS n_bases FROM dg JOIN e USING (node)),
mx AS (SELECT max(ca) AS a, max(ce_internal) AS i, max(ce_external) AS x, max(pagerank) AS p, max(betweenness) AS b, max(git_hotness) AS g FROM me),
ri AS (SELECT me.*, round(100 * (0.24 * instability + 0.20 * ca / a + 0.14 * betweenness / b + 0.12 * ce_internal / i + 0.10 * pagerank / p + 0.08 * git_hotness / g
  + CASE WHEN scc_size > 1 THEN 0.06 ELSE 0 END + CASE WHEN self_call AND ca >= 2 THEN 0.03 ELSE 0 END + CASE WHEN layer <= 1 AND ce_internal >= 2 THEN 0.02 ELSE 0 END + 0.01 * ce_external / x), 2) AS risk FROM me, mx)"""


@query(f"WITH {_MEASURED} SELECT node, round(risk, 1) AS risk FROM ri")
def risk_scores(spark, sf):
    return risk.risk_scores(_measured(spark, sf)).select("node", F.round("risk", 1).alias("risk"))


@query(f"WITH {_MEASURED} SELECT node, risk, ca, ca >= 3 AND risk >= 60 AS single_point FROM ri ORDER BY risk DESC, ca DESC, ce_total DESC, node LIMIT 20")
def risk_topk(spark, sf):
    return risk.top_risks(risk.risk_scores(_measured(spark, sf)), 20).select("node", "risk", "ca", "single_point")


@query(f"""WITH {_MEASURED} SELECT node, concat_ws(',',
  CASE WHEN instability >= 0.8 AND ce_internal >= 2 THEN 'unstable' END, CASE WHEN ca >= greatest(3, ceil(a * 0.6)) THEN 'many_dependents' END,
  CASE WHEN ce_internal >= greatest(3, ceil(i * 0.6)) THEN 'many_dependencies' END, CASE WHEN scc_size > 1 THEN 'in_cycle' END,
  CASE WHEN betweenness >= greatest(0.05, b * 0.6) THEN 'bridge' END, CASE WHEN self_call AND ca >= 2 THEN 'self_recursive' END,
  CASE WHEN layer <= 1 AND ce_internal >= 2 THEN 'upper_layer_fan_out' END, CASE WHEN n_bases > 0 THEN 'inherits' END,
  CASE WHEN ce_external >= 5 AND ce_internal >= 1 THEN 'external_surface' END, CASE WHEN git_hotness >= 0.7 AND (ca >= 1 OR ce_internal >= 2) THEN 'hotspot' END,
  CASE WHEN instability >= 0.7 OR ca >= 3 OR ce_internal >= 3 THEN 'signals_under_pressure' END) AS reasons
FROM ri, mx WHERE scc_size > 1 OR n_bases > 0""")
def risk_reasons(spark, sf):
    rows = risk.risk_scores(_measured(spark, sf)).withColumn("signals", F.array(F.lit("caching")))
    out = risk.reasons(rows, git=True).where("scc_size > 1 or n_bases > 0")
    return out.select("node", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH p AS (SELECT 'p:' || l_partkey AS path, CAST(l_quantity AS BIGINT) AS added, l_linenumber AS deleted FROM lineitem WHERE l_returnflag <> 'R'),
h AS (SELECT path, count(*) AS commits, sum(added + deleted)::BIGINT AS churn FROM p GROUP BY path),
r AS (SELECT *, 0.7 * ln(1 + churn) + 0.3 * ln(1 + commits) AS raw FROM h)
SELECT path, commits, churn, round(raw / (SELECT max(raw) FROM r), 6) AS hotness FROM r""")
def hotspots(spark, sf):
    line = _t(spark, sf, "lineitem")
    dash = F.when(F.col("l_returnflag") == "R", "-")
    rows = line.select(_id("p", "l_partkey").alias("path"), F.coalesce(dash, F.col("l_quantity").cast("long").cast("string")).alias("added"), F.coalesce(dash, F.col("l_linenumber").cast("string")).alias("deleted"))
    return risk.hotness(rows, places=6)


@query("""WITH m AS (SELECT module, row_number() OVER (ORDER BY module) - 1 AS k FROM (SELECT DISTINCT c_mktsegment AS module FROM customer)),
s AS (SELECT ceil(sqrt(count(*))) AS side FROM m), n AS (SELECT 'c:' || c_custkey AS node, c_mktsegment AS module, c_nationkey % 5 AS layer FROM customer)
SELECT node, round(k % side * 20 + (('0x' || substr(sha1('x:' || node), 1, 8))::BIGINT / 4294967295 - 0.5) * 3, 3) AS x,
  round(floor(k / side) * 20 + (('0x' || substr(sha1('y:' || node), 1, 8))::BIGINT / 4294967295 - 0.5) * 3, 3) AS y, CAST(-layer AS DOUBLE) AS z
FROM n JOIN m USING (module), s""")
def layout_grid(spark, sf):
    nodes = _t(spark, sf, "customer").select(_id("c", "c_custkey").alias("node"), F.col("c_mktsegment").alias("module"), (F.col("c_nationkey") % 5).alias("layer"))
    return risk.layout(nodes)


@query("""WITH o AS (SELECT 'c:' || o_custkey AS symbol, count(*) * 0.5 AS risk, year(o_orderdate) % 2 AS h FROM orders GROUP BY 1, 3),
j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, a.risk AS old_risk, b.risk AS new_risk, round(b.risk - a.risk, 2) AS change
  FROM (SELECT * FROM o WHERE h = 0) a FULL JOIN (SELECT * FROM o WHERE h = 1) b USING (symbol))
SELECT symbol, CASE WHEN old_risk IS NULL THEN 'appeared' WHEN new_risk IS NULL THEN 'resolved' WHEN change <= -1 THEN 'improved' WHEN change >= 1 THEN 'degraded' ELSE 'unchanged' END AS status,
  round(old_risk, 1) AS old_risk, round(new_risk, 1) AS new_risk, round(change, 1) AS change FROM j""")
def report_diff(spark, sf):
    o = _t(spark, sf, "orders").groupBy(_id("c", "o_custkey").alias("symbol"), (F.year("o_orderdate") % 2).alias("h")).agg((F.count("*") * 0.5).alias("risk"))
    out = risk.report_diff(o.where("h = 0"), o.where("h = 1"))
    return out.select("symbol", "status", *(F.round(c, 1).alias(c) for c in ("old_risk", "new_risk", "change")))


# Resolution

_KIND = "CASE rank WHEN 1 THEN 'direct_symbol' WHEN 2 THEN 'import_exact' ELSE 'heuristic' END"
_SCORE = "CASE rank WHEN 1 THEN 0.99 WHEN 2 THEN 0.93 ELSE 0.65 END"


def _scored(spark, sf):
    kind = F.when(F.col("rank") == 1, "direct_symbol").when(F.col("rank") == 2, "import_exact").otherwise("heuristic")
    return g2_edges(spark, sf).select("src", "dst", kind.alias("kind")).withColumn("score", resolve.resolution_score("kind"))


@query(f"""WITH {G2}, e AS (SELECT src, dst, {_KIND} AS kind, {_SCORE} AS score FROM g2),
i AS (SELECT dst AS node, 'in' AS direction, src AS other, kind, score FROM e UNION ALL SELECT src, 'out', dst, kind, score FROM e)
SELECT * FROM (SELECT node, row_number() OVER (PARTITION BY node ORDER BY score DESC, direction, kind, other) AS rank, direction, other, kind, CAST(score AS DOUBLE) AS score FROM i) WHERE rank <= 3""")
def support_edges(spark, sf):
    return graph.support_edges(_scored(spark, sf))


@query(f"""WITH {G2}, e AS (SELECT src, dst, CAST({_SCORE} AS DOUBLE) AS score FROM g2 WHERE src <> dst),
l AS (SELECT a.src, a.dst AS mid, b.dst AS far, a.score AS s1, b.score AS s2, row_number() OVER (PARTITION BY a.src, a.dst ORDER BY b.score DESC, b.dst) AS k
  FROM e a JOIN e b ON a.dst = b.src WHERE b.score >= 0.78 AND b.dst <> a.src),
p AS (SELECT src AS node, src || ' -> ' || mid || ' -> ' || far AS path, 2 AS hops, least(s1, s2) AS confidence FROM l WHERE k = 1 UNION ALL SELECT src, src || ' -> ' || dst, 1, score FROM e)
SELECT * FROM (SELECT node, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, hops DESC, path) AS rank, path, hops, confidence FROM p) WHERE rank <= 3""")
def two_hop_paths(spark, sf):
    return graph.two_hop_paths(_scored(spark, sf))


def _raw_edges(spark, sf):
    line = _t(spark, sf, "lineitem")
    how = F.when(F.col("l_linestatus") == "O", "import_exact").otherwise("heuristic")
    rows = line.select(_id("p", "l_partkey").alias("src"), _id("s", "l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), how.alias("resolution"), F.col("l_returnflag").alias("reason"))
    return rows.withColumn("score", resolve.resolution_score("resolution"))


_RAW = "ra AS (SELECT 'p:' || l_partkey AS src, 's:' || l_suppkey AS dst, l_returnflag AS kind, CASE WHEN l_linestatus = 'O' THEN 'import_exact' ELSE 'heuristic' END AS resolution, CAST(CASE WHEN l_linestatus = 'O' THEN 0.93 ELSE 0.65 END AS DOUBLE) AS score FROM lineitem)"
_MERGED = """me AS (SELECT src, dst, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, CAST(count(DISTINCT kind) AS INT) AS n_kinds, arg_max(resolution, (score, resolution, kind)) AS resolution,
  max(score) AS score, arg_max(kind, (score, resolution, kind)) AS reason FROM ra GROUP BY src, dst)"""


@query(f"WITH {_RAW}, {_MERGED} SELECT *, CASE resolution WHEN 'heuristic' THEN 'medium' ELSE 'high' END AS label FROM me")
def edge_merge(spark, sf):
    return resolve.merge_edges(_raw_edges(spark, sf))


@query(f"WITH {_RAW}, {_MERGED}, x AS (SELECT *, CASE resolution WHEN 'heuristic' THEN 'medium' ELSE 'high' END AS label FROM me) SELECT label, resolution, count(*) AS n FROM x GROUP BY GROUPING SETS ((label), (resolution), ())")
def confidence_breakdown(spark, sf):
    return resolve.confidence_breakdown(resolve.merge_edges(_raw_edges(spark, sf)))


@query("""WITH i AS (SELECT p_name AS name, 'p:' || p_partkey AS node FROM part UNION ALL SELECT string_split(p_name, ' ')[2], 'p:' || p_partkey FROM part UNION ALL SELECT c_name, 'c:' || c_custkey FROM customer)
SELECT name, min(node) AS node FROM i GROUP BY name HAVING count(*) = 1""")
def unique_names(spark, sf):
    p, c = _t(spark, sf, "part"), _t(spark, sf, "customer")
    index = p.select(F.col("p_name").alias("name"), _id("p", "p_partkey").alias("node")).unionByName(p.select(F.get(F.split("p_name", " "), F.lit(1)).alias("name"), _id("p", "p_partkey").alias("node")))
    return resolve.unique_names(index.unionByName(c.select(F.col("c_name").alias("name"), _id("c", "c_custkey").alias("node"))))


_PATHS = "pa AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


def _paths(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@query(f"""WITH {_PATHS}, i AS (SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS name FROM pa WHERE path LIKE 'blog.%' UNION SELECT DISTINCT string_split(path, '/')[1] FROM pa),
r AS (SELECT DISTINCT path AS ref FROM pa), t AS (SELECT ref, array_to_string(list_slice(string_split(ref, '/'), 1, k), '/') AS name FROM (SELECT ref, unnest(range(1, len(string_split(ref, '/')) + 1)) AS k FROM r))
SELECT ref, arg_max(name, length(name)) AS name, 'd:' || arg_max(name, length(name)) AS node FROM t JOIN i USING (name) GROUP BY ref""")
def longest_prefix(spark, sf):
    paths = _paths(spark, sf)
    first = lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/").alias("name")
    names = paths.where("path like 'blog.%'").select(first(2)).union(paths.select(first(1))).distinct()
    return resolve.longest_prefix(paths.select(F.col("path").alias("ref")), names.withColumn("node", F.concat(F.lit("d:"), "name")), "/")


@query(f"""WITH {_PATHS}, r AS (SELECT DISTINCT replace(path, '/', '.') AS ref FROM pa),
i AS (SELECT DISTINCT array_to_string(list_slice(string_split(ref, '.'), 2, 99), '.') AS name FROM r),
s AS (SELECT string_split(ref, '.')[-1] AS name FROM r),
f AS (SELECT name, 'f:' || name AS node FROM i),
t AS (SELECT ref, array_to_string(list_slice(string_split(ref, '.'), k, 99), '.') AS name, k FROM (SELECT ref, unnest(range(1, len(string_split(ref, '.')))) AS k FROM r)),
b AS (SELECT ref, node, CASE WHEN k = 1 THEN 'exact' ELSE 'suffix' END AS how, k AS prio FROM t JOIN f USING (name)
  UNION ALL SELECT ref, 'l:' || name, 'unique', 1000 FROM (SELECT ref, string_split(ref, '.')[-1] AS name FROM r) JOIN (SELECT name FROM s GROUP BY name HAVING count(*) = 1) USING (name))
SELECT ref, arg_min(node, prio) AS node, arg_min(how, prio) AS how FROM b GROUP BY ref""")
def dotted_lookup(spark, sf):
    refs = _paths(spark, sf).select(F.translate("path", "/", ".").alias("ref")).distinct()
    parts = F.split("ref", r"\.")
    index = refs.select(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ".").alias("name")).distinct().withColumn("node", F.concat(F.lit("f:"), "name"))
    short = refs.select(F.element_at(parts, -1).alias("name")).withColumn("node", F.concat(F.lit("l:"), "name"))
    return resolve.dotted_lookup(refs, index, short)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem),
a AS (SELECT o_orderkey, 'o:' || o_orderkey AS t FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT p_partkey, 'p:' || p_partkey AS t FROM part WHERE p_size <= 20),
c AS (SELECT s_suppkey, 's:' || s_suppkey AS t FROM supplier WHERE s_acctbal > 0),
j AS (SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, coalesce(a.t, b.t, c.t) AS target, CASE WHEN a.t IS NOT NULL THEN 'direct_symbol' WHEN b.t IS NOT NULL THEN 'import_exact' WHEN c.t IS NOT NULL THEN 'heuristic' END AS kind
  FROM r LEFT JOIN a ON l_orderkey = o_orderkey LEFT JOIN b ON l_partkey = p_partkey LEFT JOIN c ON l_suppkey = s_suppkey)
SELECT kind, target, count(*) AS n FROM j GROUP BY kind, target""")
def cascade_resolve(spark, sf):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    refs = _t(spark, sf, "lineitem").select(*key).withColumn("n", F.lit(1)).groupBy(*key).agg(F.sum("n").alias("n"))
    o, p, s = (_t(spark, sf, x) for x in ("orders", "part", "supplier"))
    first = refs.join(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(*key, _id("o", "l_orderkey").alias("target"), F.lit("direct_symbol").alias("kind"))
    second = refs.join(p.where("p_size <= 20").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select(*key, _id("p", "l_partkey").alias("target"), F.lit("import_exact").alias("kind"))
    third = refs.join(s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").select(*key, _id("s", "l_suppkey").alias("target"), F.lit("heuristic").alias("kind"))
    return resolve.cascade(refs, [first, second, third], key).groupBy("kind", "target").agg(F.sum("n").alias("n"))


@query("SELECT 'c:' || c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def unresolved_anti(spark, sf):
    return resolve.unresolved(_t(spark, sf, "customer").select(_id("c", "c_custkey").alias("node")), _t(spark, sf, "orders").where("o_orderstatus = 'P'").select(_id("c", "o_custkey").alias("node")), ["node"])


# Ranges of lines: a document takes some lines of its source

_SPANS = "sp AS (SELECT 'd' || doc_id AS node, source AS file, CAST(1 + doc_id * 37 % 4000 AS INT) AS start, CAST(1 + doc_id * 37 % 4000 + n_chars % 25 AS INT) AS stop, n_chars, lang FROM documents)"


def _spans(spark, sf):
    start = 1 + F.col("doc_id") * 37 % 4000
    return _t(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node"), F.col("source").alias("file"), start.cast("int").alias("start"), (start + F.col("n_chars") % 25).cast("int").alias("stop"), "n_chars", "lang")


@query(f"WITH {_SPANS} SELECT a.node AS \"outer\", b.node AS \"inner\" FROM sp a JOIN sp b ON a.file = b.file AND b.start >= a.start AND b.stop <= a.stop AND a.node <> b.node")
def range_containment(spark, sf):
    return intervals.contained(_spans(spark, sf))


@query(f"""WITH {_SPANS}, o AS (SELECT *, max(stop) OVER (PARTITION BY file ORDER BY start, stop, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start, stop, node ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT file, min(start) AS start, max(stop) AS stop, count(*) AS n, string_agg(DISTINCT node, ',' ORDER BY node) AS names, max(n_chars) AS score FROM i GROUP BY file, k""")
def slice_merge(spark, sf):
    return intervals.merge_slices(_spans(spark, sf).withColumnsRenamed({"node": "name", "n_chars": "score"}))


@query(f"WITH {_SPANS} SELECT node FROM sp WHERE EXISTS (SELECT 1 FROM sp b WHERE b.file = sp.file AND b.start <= sp.start AND b.stop >= sp.stop AND b.lang <> 'en')")
def slice_coverage(spark, sf):
    rows = _spans(spark, sf)
    return intervals.covered(rows, rows.where("lang <> 'en'")).select("node")


@query(f"WITH {_SPANS} SELECT a.node, a.file, b.node AS target FROM sp a JOIN sp b ON a.file = b.file AND b.start <= a.stop AND b.stop >= a.start")
def slice_overlap(spark, sf):
    rows = _spans(spark, sf)
    return intervals.overlapping(rows, rows.withColumnRenamed("node", "target"))


_LINES = "ln AS (SELECT 'd' || doc_id AS node, source AS file, CAST(i AS INT) AS lineno, lines[i] AS text FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents)))"


def _lines(spark, sf):
    rows = _t(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node"), F.col("source").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
    return rows.select("node", "file", F.lit("prose").alias("language"), (F.col("p") + 1).alias("lineno"), "text")


@query(f"""WITH {_LINES}, u AS (SELECT 'd' || doc_id AS node, len(string_split(text, chr(10))) AS n FROM documents),
b AS (SELECT node, CAST(2 + n // 3 AS INT) AS s, CAST(n - n // 4 AS INT) AS e FROM u)
SELECT ln.node, ln.file, ln.lineno FROM ln JOIN b ON ln.node = b.node WHERE NOT (lineno BETWEEN s AND e)""")
def own_lines(spark, sf):
    lines = _lines(spark, sf)
    n = lines.groupBy("node").agg(F.max("lineno").alias("n"))
    whole = n.select("node", F.col("node").alias("file"), F.lit(1).alias("start"), F.col("n").alias("stop"))
    body = n.select(F.concat("node", F.lit("/body")).alias("node"), F.col("node").alias("file"), (2 + F.floor(F.col("n") / 3)).cast("int").alias("start"), (F.col("n") - F.floor(F.col("n") / 4)).cast("int").alias("stop")).where("start <= stop and not (start = 1 and stop = 1)")
    got = intervals.own_lines(lines.select(F.col("node").alias("file"), "lineno", "text"), whole.unionByName(body)).where(~F.col("node").contains("/"))
    return got.select("node", "lineno").join(lines.select("node", "lineno", "file"), ["node", "lineno"]).select("node", "file", "lineno")


_TESTS = [
    ("input_boundary", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "an address"),
    ("config_access", r"(password|token|secret)", "a credential word"),
    ("serialization", r"[|].*[|]", "a table row"),
    ("state_mutation", r"[0-9]{4}", "a long number"),
    ("network_io", r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "a numeric address"),
    ("validation_guard", r"[Ll]icensed", "a licence"),
]
_PROSE = [(("prose",), s, p, r) for s, p, r in _TESTS]
_HITS = "hi AS (" + " UNION ALL ".join(f"SELECT node, file, '{s}' AS signal, lineno AS start, lineno AS stop, '{r}' AS reason FROM ln WHERE regexp_matches(text, '{p}')" for s, p, r in _TESTS) + ")"
_WEIGHT = "CASE signal " + " ".join(f"WHEN '{s}' THEN {signals.SIGNAL_WEIGHT[s]}" for s, _, _ in _TESTS) + " WHEN 'external_io' THEN 2.2 WHEN 'dynamic_dispatch' THEN 2.0 END"


@query(f"WITH {_LINES}, {_HITS} SELECT * FROM hi")
def signal_hits(spark, sf):
    return signals.match_lines(_lines(spark, sf), _PROSE)


_TOP = f"SELECT * FROM (SELECT node, file, signal, start, stop, reason, row_number() OVER (PARTITION BY node ORDER BY {_WEIGHT} DESC, start, stop, signal, reason) AS rank FROM {{}}) WHERE rank <= 12"
_EVIDENCE = f"""{_LINES}, {_HITS}, k1 AS ({_TOP.format("hi")}),
ex AS (SELECT node, min(rank) AS r FROM k1 WHERE signal = 'network_io' GROUP BY node),
un AS (SELECT node, file, signal, start, stop, reason FROM k1 UNION ALL SELECT k1.node, file, 'external_io', start, stop, 'reaches outside by ' || signal FROM k1 JOIN ex ON k1.node = ex.node AND k1.rank = ex.r),
ev AS ({_TOP.format("un")})"""


@query(f"WITH {_EVIDENCE} SELECT * FROM ev")
def signal_evidence(spark, sf):
    return signals.evidence(signal_hits(spark, sf)).select("node", "file", "signal", "start", "stop", "reason", "rank")


@query(f"""WITH {_EVIDENCE}, o AS (SELECT node, signal, count(*) AS n, {_WEIGHT} AS w FROM ev GROUP BY node, signal)
SELECT node, string_agg(signal, ',' ORDER BY w DESC, signal) AS signals, round(CAST(sum(w) AS DOUBLE), 2) AS weight, CAST(sum(n) AS BIGINT) AS n_refs,
  concat_ws(',', CASE WHEN bool_or(signal IN ('process_io', 'database_io', 'network_io', 'concurrency', 'state_mutation', 'filesystem_io', 'external_io')) THEN 'side_effect' END,
    CASE WHEN bool_or(signal IN ('input_boundary', 'output_boundary')) THEN 'boundary' END, CASE WHEN bool_or(signal IN ('auth_guard', 'validation_guard', 'error_handling')) THEN 'guard' END) AS families
FROM o GROUP BY node""")
def signal_summary(spark, sf):
    out = signals.node_signals(signal_evidence(spark, sf))
    return out.withColumn("signals", F.array_join("signals", ","))


@query(f"""WITH {_EVIDENCE}, s AS (SELECT node, any_value(file) AS file, list(DISTINCT signal) AS sg, min(start) AS fine, max(stop) - min(start) AS span FROM ev GROUP BY node)
SELECT node FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.file = s.file AND b.node <> s.node AND list_has_all(b.sg, s.sg) AND (b.fine > s.fine OR (b.fine = s.fine AND b.span < s.span)))""")
def shadowed(spark, sf):
    rows = signal_evidence(spark, sf).groupBy("node").agg(F.first("file").alias("file"), F.collect_set("signal").alias("signals"), F.min("start").alias("fineness"), (F.max("stop") - F.min("start")).alias("span"))
    return intervals.not_shadowed(rows).select("node")


@query("""WITH o AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, ts, event_id FROM events)
SELECT user_id, event_id, event_type FROM o WHERE b IS NULL OR b <> event_type""")
def flow_compact(spark, sf):
    return signals.compact(_t(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


_STEP_OF = {"click": "input_boundary", "error": "error_handling", "purchase": "database_io", "signup": "output_boundary", "view": "config_access"}
_CASE_STEP = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STEP_OF.items()) + " END"
_STEP_RANK = "CASE signal " + " ".join(f"WHEN '{v}' THEN {signals.STEP_ORDER[v]}" for v in _STEP_OF.values()) + " END"
_FLOW = f"""r AS (SELECT 'u:' || user_id AS node, {_CASE_STEP} AS signal, event_id // 300 AS start, value > 20 AS named, min(event_id // 300) OVER (PARTITION BY user_id) AS first FROM events),
d AS (SELECT DISTINCT node, signal, start FROM r WHERE NOT (signal = 'output_boundary' AND named AND start <= first)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY start, {_STEP_RANK}, signal) AS k FROM d) WHERE k <= 12),
e AS (SELECT node, min(start) AS effect FROM o WHERE signal = 'database_io' GROUP BY node),
f AS (SELECT o.* FROM o LEFT JOIN e USING (node) WHERE NOT (signal = 'output_boundary' AND coalesce(start < effect, false) AND EXISTS (SELECT 1 FROM o x WHERE x.node = o.node AND x.start = o.start AND x.signal <> 'output_boundary'))),
st AS (SELECT node, row_number() OVER (PARTITION BY node ORDER BY k) AS step, signal, start, start AS stop FROM f)"""


@query(f"WITH {_FLOW} SELECT * FROM st")
def flow_steps(spark, sf):
    e = _t(spark, sf, "events")
    signal = F.create_map(*(F.lit(x) for k, v in _STEP_OF.items() for x in (k, v)))[F.col("event_type")]
    line = F.floor(F.col("event_id") / 300)
    reason = F.when(F.col("value") > 20, "names a response object").otherwise("sends output")
    refs = e.select(_id("u", "user_id").alias("node"), F.lit("f").alias("file"), signal.alias("signal"), line.alias("start"), line.alias("stop"), reason.alias("reason"))
    return signals.flow_steps(refs, refs.groupBy("node").agg(F.min("start").alias("start")).withColumn("kind", F.lit("function")))


@query(f"""WITH {_FLOW},
s AS (SELECT *, lag(signal) OVER (PARTITION BY node ORDER BY step) AS b FROM st),
c AS (SELECT * FROM s WHERE b IS NULL OR b <> signal)
SELECT node, string_agg(signal, ' -> ' ORDER BY step) AS path,
  coalesce(min(step) FILTER (signal = 'input_boundary') < min(step) FILTER (signal = 'database_io'), false) AS boundary_first,
  arg_max(signal, step) = 'output_boundary' AS ends_in_output, bool_or(signal = 'error_handling') AS handles_errors FROM c GROUP BY node""")
def flow_summary(spark, sf):
    return signals.flow_summary(flow_steps(spark, sf))


# Evidence

_W5 = {k: signals.SIGNAL_WEIGHT[k] for k in _SIGNAL_OF.values()}
_W5_CASE = "CASE signal " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in _W5.items()) + " END"
_SHOWN = f"""us AS (SELECT DISTINCT 'u:' || user_id AS node, {_CASE_SIGNAL} AS signal FROM events WHERE value > 20),
ut AS (SELECT 'u:' || user_id AS node, max(event_id) AS m, count(*) AS n FROM events GROUP BY 1),
un AS (SELECT node, list(signal) AS s, round(CAST(sum({_W5_CASE}) AS DOUBLE), 2) AS weight, any_value(n) % 100 / 2 AS risk, any_value(m) % 7 = 0 AS ambiguous, CASE WHEN any_value(m) % 5 = 0 THEN 'module' ELSE 'function' END AS kind
  FROM us JOIN ut USING (node) GROUP BY node)"""


def _shown(spark, sf):
    """Users as nodes with signals, and weights, risks and kinds made from their events."""
    e = _t(spark, sf, "events").groupBy(_id("u", "user_id").alias("node")).agg(F.max("event_id").alias("m"), F.count("*").alias("n"))
    rows = _user_signals(spark, sf).join(e, "node")
    weight = F.round(F.aggregate("signals", F.lit(0.0), lambda a, x: a + signals.signal_weight(x)), 2)
    return rows.select("node", "signals", weight.alias("weight"), (F.col("n") % 100 / 2).alias("risk"), (F.col("m") % 7 == 0).alias("ambiguous"), F.when(F.col("m") % 5 == 0, "module").otherwise("function").alias("kind"))


@query(f"""WITH {_SHOWN}, x AS (SELECT *, round(CAST(3 * weight + least(risk / 12, 8) + CASE WHEN list_contains(s, 'input_boundary') THEN 3 ELSE 0 END
  + CASE WHEN list_has_any(s, ['database_io', 'network_io']) THEN 2 ELSE 0 END - CASE WHEN kind = 'module' THEN 1 ELSE 0 END AS DOUBLE), 2) AS score FROM un)
SELECT node, score, row_number() OVER (ORDER BY score DESC, weight DESC, risk DESC, node) AS rank FROM x ORDER BY rank LIMIT 10""")
def signal_candidates(spark, sf):
    return evidence.signal_candidates(_shown(spark, sf)).select("node", "score", "rank")


@query(f"""WITH {_SHOWN}, x AS (SELECT *, concat_ws(',', CASE WHEN ambiguous AND list_has_any(s, ['input_boundary', 'database_io', 'state_mutation', 'network_io']) THEN 'ambiguous_and_critical' END,
  CASE WHEN list_contains(s, 'state_mutation') AND list_has_any(s, ['database_io', 'network_io']) THEN 'mutation_with_outside_effects' END) AS why FROM un)
SELECT node, why FROM x WHERE why <> '' ORDER BY weight DESC, risk DESC, node LIMIT 8""")
def signal_watchlist(spark, sf):
    return evidence.watchlist(_shown(spark, sf)).withColumn("why", F.array_join("why", ","))


@query(f"""WITH {_SHOWN}, x AS (SELECT CAST(substr(node, 3) AS BIGINT) % 10 AS id, node, list_sort(list_filter(['caching', 'database_io', 'network_io', 'state_mutation'], lambda w: NOT list_contains(s, w))) AS g FROM un),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(g) DESC, node) AS k FROM x WHERE len(g) > 0)
SELECT CAST(id AS VARCHAR) AS id, node, array_to_string(g, ',') AS missing FROM k WHERE k <= 4""")
def flow_gaps(spark, sf):
    wanted = F.array(*map(F.lit, ("caching", "database_io", "network_io", "state_mutation")))
    rows = _shown(spark, sf).select((F.substring_index("node", ":", -1).cast("long") % 10).cast("string").alias("id"), "node", wanted.alias("wanted"), F.col("signals").alias("shown"))
    return evidence.flow_gaps(rows).withColumn("missing", F.array_join("missing", ","))


@query(f"""WITH {_SHOWN}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g4 UNION ALL SELECT dst FROM g4) GROUP BY node)
SELECT node, round(CAST(risk + 10 * 0.93 + least(6, degree) + CASE WHEN ambiguous THEN -4 ELSE 0 END + round(CAST(greatest(0, 1.7 * weight + CASE WHEN list_contains(s, 'input_boundary') THEN 4 ELSE 0 END
  + CASE WHEN list_has_any(s, ['input_boundary', 'database_io', 'state_mutation', 'network_io']) THEN 2 + CASE WHEN ambiguous THEN 1.5 ELSE 0 END ELSE 0 END - CASE WHEN kind = 'module' THEN 1 ELSE 0 END) AS DOUBLE), 2) AS DOUBLE), 1) AS priority
FROM un JOIN d USING (node)""".replace(f"WITH {_SHOWN}", f"WITH {_g4(2)}, {_SHOWN}", 1))
def evidence_priority(spark, sf):
    edges = g4_edges(spark, sf, 2)
    degree = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    rows = _shown(spark, sf).join(degree, "node").withColumn("best_score", F.lit(0.93)).withColumn("n_ambiguous", F.col("ambiguous").cast("int")).drop("ambiguous")
    return evidence.evidence_priority(rows).select("node", F.round("priority", 1).alias("priority"))


@query(f"""WITH r AS (SELECT CAST(user_id % 7 AS VARCHAR) AS file, 'u:' || user_id AS node, {_CASE_SIGNAL} AS signal FROM events WHERE value > 45),
o AS (SELECT file, signal, {_W5_CASE} AS w FROM r GROUP BY file, signal), p AS (SELECT file, string_agg(signal, ',' ORDER BY w DESC, signal) AS signals, round(CAST(sum(w) AS DOUBLE), 2) AS weight FROM o GROUP BY file)
SELECT file, signals, weight, n_nodes FROM p JOIN (SELECT file, count(DISTINCT node) AS n_nodes FROM r GROUP BY file) USING (file) ORDER BY weight DESC, n_nodes DESC, file LIMIT 8""")
def files_by_weight(spark, sf):
    e = _t(spark, sf, "events").where("value > 45")
    signal = F.create_map(*(F.lit(x) for k, v in _SIGNAL_OF.items() for x in (k, v)))[F.col("event_type")]
    refs = e.select((F.col("user_id") % 7).cast("string").alias("file"), _id("u", "user_id").alias("node"), signal.alias("signal"))
    return evidence.files_by_weight(refs).withColumn("signals", F.array_join("signals", ","))


# Questions

_QUESTIONS = [("q1", "Which small ring reaches the database?"), ("q2", "how is the ECONOMY widget request validated"), ("q3", "why does Customer 7 fail"), ("q4", "the")]


def _questions(spark):
    return retrieve.analyse_questions(spark.createDataFrame(_QUESTIONS, "id string, question string"))


_Q_VALUES = ", ".join(f"('{i}', '{q}')" for i, q in _QUESTIONS)


@query(f"""WITH q(id, question) AS (VALUES {_Q_VALUES}), t AS (SELECT id, trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) AS plain, string_split(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM q),
s AS (SELECT id, plain, list_filter(list_distinct(w), lambda x: (length(x) > 2 OR x = 'di') AND x NOT IN ({", ".join(f"'{w}'" for w in tx.STOPWORDS)})) AS k FROM t)
SELECT id, plain, array_to_string(list_sort(k), ',') AS tokens FROM s""")
def query_tokens(spark, sf):
    return _questions(spark).select("id", "plain", F.array_join(F.array_sort("strict"), ",").alias("tokens"))


@query(f"""WITH q(id, question) AS (VALUES {_Q_VALUES}), s AS (SELECT id, ' ' || trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) || ' ' AS plain, string_split(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM q),
n AS (SELECT 'p:' || p_partkey AS node, p_name AS name, string_split(p_name, ' ') AS parts, p_size AS span FROM part),
j AS (SELECT id, node, span, CASE WHEN contains(name, ' ') AND contains(plain, name) THEN 14.0 ELSE 0.0 END AS a,
  len(list_filter(parts, lambda x: list_contains(w, x))) AS c FROM n, s),
k AS (SELECT *, greatest(a, CASE WHEN c >= 2 THEN least(6.0, 1.5 * c) ELSE 0.0 END) AS score FROM j)
SELECT * FROM (SELECT id, node, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, span, node) AS rank FROM k WHERE score > 0) WHERE rank <= 8""")
def query_mentions(spark, sf):
    names = _t(spark, sf, "part").select(_id("p", "p_partkey").alias("node"), F.array("p_name").alias("forms"), F.lit("class").alias("kind"), F.col("p_size").alias("span"))
    return retrieve.mentions(_questions(spark), names)


@query("""WITH RECURSIVE c AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
f AS (SELECT p_brand, 0::BIGINT AS r, 0::BIGINT AS used, false AS taken, NULL::BIGINT AS p_partkey FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT c.p_brand, c.r, CASE WHEN c.r <= 1 OR used + p_size <= 86 THEN used + p_size ELSE used END, c.r <= 1 OR used + p_size <= 86, c.p_partkey FROM f JOIN c ON c.p_brand = f.p_brand AND c.r = f.r + 1)
SELECT p_brand, p_partkey, taken FROM f WHERE r > 0""")
def budget_select(spark, sf):
    rows = _t(spark, sf, "part").withColumn("key", F.col("p_partkey"))
    return retrieve.within_budget(rows, "p_brand", [F.desc("p_retailprice"), "p_partkey"], "p_size", 120, first=1, share=0.72).select("p_brand", "p_partkey", "taken")


@query("""WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS seen FROM events GROUP BY user_id),
m AS (SELECT user_id, list_reduce(list_prepend('0', seen), lambda k, x: CASE WHEN CAST(k AS INT) < 4 AND x = ['view', 'click', 'signup', 'purchase'][CAST(k AS INT) + 1] THEN CAST(CAST(k AS INT) + 1 AS VARCHAR) ELSE k END) AS k FROM e)
SELECT user_id, CAST(k AS INT) AS matched, round(CAST(k AS INT) / 4, 2) AS ratio, CASE WHEN k = '4' THEN 'complete_in_order' WHEN k = '0' THEN 'diverged_before_start' ELSE 'partial_with_divergence' END AS sequence_status FROM m""")
def read_order(spark, sf):
    e = _t(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("observed"))
    rows = e.withColumn("required", F.array(*map(F.lit, ("view", "click", "signup", "purchase"))))
    return contract.read_order(rows).select("user_id", "matched", "ratio", "sequence_status")


@query("""WITH e AS (SELECT user_id, list(DISTINCT event_type) AS seen FROM events WHERE value > 30 GROUP BY user_id),
m AS (SELECT user_id, len(list_filter(['view', 'click', 'signup'], lambda x: list_contains(seen, x))) AS k FROM e)
SELECT user_id, CAST(k AS INT) AS matched, round(k / 3, 2) AS ratio, CASE WHEN k = 0 THEN 'not_started' WHEN k = 3 THEN 'complete' ELSE 'partial' END AS status FROM m""")
def primary_coverage(spark, sf):
    e = _t(spark, sf, "events").where("value > 30").groupBy("user_id").agg(F.collect_set("event_type").alias("observed"))
    rows = contract.primary_coverage(e.withColumn("required", F.array(*map(F.lit, ("view", "click", "signup")))))
    return rows.select("user_id", F.size("matched").alias("matched"), "ratio", "status")


@query("""WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS seen, max(event_id) AS m FROM events GROUP BY user_id),
r AS (SELECT user_id, seen, ['a', 'b', 'c'][m % 3 + 1] AS used, ['ambiguous', 'partial', 'confirmed', 'unproven', ''][m % 5 + 1] AS said, ['done', ''][m % 2 + 1] AS stop,
  ['in_progress', 'completed_within_bounds', 'odd'][m % 3 + 1] AS state, m % 4 = 0 AS followed, list_position(seen, 'view') AS v FROM e),
q AS (SELECT *, state = 'completed_within_bounds' AS final, v IS NULL AS missing, CASE WHEN v IS NULL THEN 0 WHEN list_contains(seen[v + 1:], 'click') THEN 2 ELSE 1 END AS matched FROM r),
x AS (SELECT *, array_to_string(list_filter([
    CASE WHEN used <> 'a' THEN 'must_respect_allowed_claims' END,
    CASE WHEN used = 'b' THEN 'must_not_use_disallowed_claims' END,
    CASE WHEN said = 'confirmed' THEN 'must_not_exceed_outcome_ceiling' END,
    CASE WHEN said = 'unproven' THEN 'must_not_drop_below_minimum_honest_outcome' END,
    CASE WHEN said = '' AND final THEN 'must_set_final_outcome_for_terminal_result' END,
    CASE WHEN seen[1] <> 'view' THEN 'must_read_primary_slice_first' END,
    CASE WHEN final AND matched < 2 THEN 'must_read_required_sequence_for_terminal_result' END,
    CASE WHEN final AND missing THEN 'must_cover_required_primary_symbols_for_terminal_result' END,
    CASE WHEN state = 'odd' OR final AND stop <> 'done' THEN 'must_stop_when_completion_criteria_met' END,
    CASE WHEN followed THEN 'must_not_open_followup_when_disabled' END,
    CASE WHEN said NOT IN ('', 'ambiguous') THEN 'must_not_claim_uniqueness_while_ambiguous' END], lambda t: t IS NOT NULL), ',') AS violations,
  array_to_string(list_filter([CASE WHEN said = '' AND state = 'odd' THEN 'must_not_exceed_outcome_ceiling' END,
    CASE WHEN missing AND NOT final THEN 'must_cover_required_primary_symbols_for_terminal_result' END], lambda t: t IS NOT NULL), ',') AS warnings,
  CASE WHEN said IN ('', 'confirmed') THEN 'partial' ELSE said END AS capped_outcome FROM q),
y AS (SELECT *, CASE WHEN violations <> '' THEN 'rejected' WHEN state = 'in_progress' THEN 'open' WHEN warnings <> '' THEN 'accepted_with_warnings' ELSE 'accepted' END AS status FROM x)
SELECT user_id, violations = '' AS valid, violations, warnings, capped_outcome, status, CASE status WHEN 'rejected' THEN 'fix_violations' WHEN 'open' THEN 'continue' ELSE 'close' END AS next_action FROM y""")
def contract_validation(spark, sf):
    """A result a user: the events are what was inspected."""
    e = _t(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("seen"), F.max("event_id").alias("m"))
    texts = lambda *x: F.array(*map(F.lit, x))
    pick = lambda options: F.get(texts(*options), (F.col("m") % len(options)).cast("int"))
    rows = e.select(
        "user_id", texts("a", "b").alias("allowed_claims"), texts("b").alias("disallowed_claims"), texts("view", "click").alias("required_read_order_refs"), texts("view").alias("required_primary_symbols"),
        texts("done").alias("valid_stop_conditions"), texts("in_progress", "completed_within_bounds", "invalid_result").alias("supported_states"), texts("must_not_claim_uniqueness_while_ambiguous").alias("rules"),
        F.lit("partial").alias("expected_ceiling"), F.lit("ambiguous").alias("minimum_honest"), F.lit(False).alias("followup_allowed"), F.col("seen").alias("inspected_slice_refs"), F.col("seen").alias("inspected_symbols"),
        F.array(pick(("a", "b", "c"))).alias("used_claims"), F.lit("a").alias("final_claim"), pick(("ambiguous", "partial", "confirmed", "unproven", "")).alias("final_outcome"), pick(("done", "")).alias("stop_condition"),
        pick(("in_progress", "completed_within_bounds", "odd")).alias("completion_state"), (F.col("m") % 4 == 0).alias("followup_used"),
    )
    out = contract.result_report(contract.validate(rows))
    return out.select("user_id", "valid", F.array_join("violations", ",").alias("violations"), F.array_join("warnings", ",").alias("warnings"), "capped_outcome", "status", "next_action")


# Names


@query("""SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS compact, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS spaced,
  CASE WHEN trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'item' ELSE trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') END AS slug, translate(lower(url), ' -', '__') AS snake FROM pages""")
def name_forms(spark, sf):
    return _t(spark, sf, "pages").select("page_id", tx.compact_text("url").alias("compact"), tx.spaced_text("url").alias("spaced"), tx.slug("url").alias("slug"), tx.snake("url").alias("snake"))


@query(f"""WITH {_PATHS}, x AS (SELECT coalesce(nullif(regexp_extract(path, '/[^/]*([.][A-Za-z0-9]+)$', 1), ''), '(none)') AS suffix FROM pa)
SELECT suffix, count(*) AS n FROM x GROUP BY suffix ORDER BY n DESC, suffix LIMIT 12""")
def extension_topk(spark, sf):
    suffix = F.regexp_extract("path", r"/[^/]*([.][A-Za-z0-9]+)$", 1)
    rows = _paths(spark, sf).select(F.when(suffix == "", "(none)").otherwise(suffix).alias("suffix"))
    return rows.groupBy("suffix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(12)
