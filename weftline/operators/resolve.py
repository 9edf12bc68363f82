"""Resolution of references: prioritised strategies, unique names, longest prefixes and suffixes, edge merging.

A strategy is a DataFrame that proposes targets for references; strategies are
joins, independent of each other, and Catalyst orders and picks them. Priority
is a column, so the first one that hits wins whatever the plan does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.constants import RESOLUTION


def resolution_score(kind: Column | str) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.create_map(*(F.lit(x) for k, (score, _) in RESOLUTION.items() for x in (k, score)))[kind]


def resolution_label(kind: Column | str) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.create_map(*(F.lit(x) for k, (_, label) in RESOLUTION.items() for x in (k, label)))[kind]


def cascade(refs: DataFrame, strategies: list[DataFrame], key: list[str]) -> DataFrame:
    """refs with target, kind, score and label of the first strategy that has a target for them; null if none has.

    Each strategy has the key columns, target and kind. Several targets of one
    strategy for a reference: the least by name. A strategy that proposes a
    null target stops the cascade there: the reference stays unresolved.
    """
    every = None
    for k, s in enumerate(strategies):
        s = s.select(*key, F.struct(F.lit(k).alias("prio"), F.col("target").isNotNull().alias("has"), "target", "kind").alias("hit"))
        every = s if every is None else every.unionByName(s)
    best = every.groupBy(*key).agg(F.min("hit").alias("hit"))
    out = refs.join(best, key, "left").withColumn("target", F.col("hit.target"))
    out = out.withColumn("kind", F.when(F.col("target").isNotNull(), F.col("hit.kind"))).drop("hit")
    return out.withColumn("score", resolution_score("kind")).withColumn("label", resolution_label("kind"))


def unresolved(refs: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """The references without an edge."""
    return refs.join(edges.select(*key).distinct(), key, "left_anti")


def unique_names(index: DataFrame) -> DataFrame:
    """(name, node) of the names with one entry in index(name, node).

    An entry that is there twice is two entries: such a name is not unique,
    even if both lead to one node.
    """
    return index.groupBy("name").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").select("name", "node")


def prefixes(name: Column, separator: str) -> Column:
    """All prefixes of a separated name, whole parts each, longest last."""
    parts = F.split(name, f"\\Q{separator}\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator))


def suffixes(name: Column, separator: str, least: int = 1) -> Column:
    """All proper suffixes of at least `least` whole parts, longest first."""
    parts = F.split(name, f"\\Q{separator}\\E")
    count = F.size(parts)
    start = F.when(count > least, F.sequence(F.lit(2), count - least + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(start, lambda k: F.array_join(F.slice(parts, k, count), separator))


def longest_prefix(refs: DataFrame, index: DataFrame, separator: str = "::") -> DataFrame:
    """(ref, name, node): for each refs(ref) the longest prefix that index(name, node) holds. Equi-joins on all prefixes."""
    tried = refs.select("ref").distinct().withColumn("name", F.explode(prefixes(F.col("ref"), separator)))
    hits = tried.join(index.select("name", "node"), "name")
    return hits.groupBy("ref").agg(F.max(F.struct(F.length("name").alias("n"), "name", "node")).alias("b")).select("ref", "b.name", "b.node")


def dotted_lookup(refs: DataFrame, index: DataFrame, short: DataFrame, separator: str = ".") -> DataFrame:
    """(ref, node, how): exact name, else the longest proper suffix of two parts or more, else a unique last part.

    index(name, node) holds full names, short(name, node) last parts, with repeats.
    """
    refs = refs.select("ref").distinct()
    full = index.groupBy("name").agg(F.max("node").alias("node"))
    exact = refs.join(full, refs.ref == full.name).select("ref", "node", F.lit(0).alias("prio"), F.lit(0).alias("n"), F.lit("exact").alias("how"))
    tried = refs.withColumn("name", F.explode(suffixes(F.col("ref"), separator, 2)))
    tail = tried.join(full, "name").select("ref", "node", F.lit(1).alias("prio"), (-F.length("name")).alias("n"), F.lit("suffix").alias("how"))
    last = refs.withColumn("name", F.element_at(F.split("ref", f"\\Q{separator}\\E"), -1))
    lone = last.join(unique_names(short), "name").select("ref", "node", F.lit(2).alias("prio"), F.lit(0).alias("n"), F.lit("unique").alias("how"))
    best = exact.unionByName(tail).unionByName(lone).groupBy("ref").agg(F.min(F.struct("prio", "n", "node", "how")).alias("b"))
    return best.select("ref", "b.node", "b.how")


def merge_edges(raw: DataFrame) -> DataFrame:
    """(src, dst, kinds, n_kinds, resolution, score, label, reason): one row a pair of raw(src, dst, kind, resolution, score, reason).

    kinds: distinct kinds, sorted, comma-joined. The provenance is that of the
    greatest (score, resolution, reason).
    """
    best = F.max(F.struct("score", "resolution", "reason")).alias("b")
    out = raw.groupBy("src", "dst").agg(F.array_sort(F.collect_set("kind")).alias("k"), best)
    out = out.select("src", "dst", F.array_join("k", ",").alias("kinds"), F.size("k").alias("n_kinds"), "b.resolution", "b.score", "b.reason")
    return out.withColumn("label", resolution_label("resolution"))


def confidence_breakdown(edges: DataFrame) -> DataFrame:
    """(label, resolution, n): edges by label, by resolution and in all; null stands for all."""
    out = edges.groupingSets([["label"], ["resolution"], []], "label", "resolution").agg(F.count("*").alias("n"))
    return out
