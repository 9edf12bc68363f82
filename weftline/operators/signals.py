"""What lines of code do: signals, guards, their limits and roll-ups, steps, rules and tainted input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.constants import (
    AUTH_WORDS, BOUNDARY, EXECUTABLE_KINDS, EXTERNAL_IO, GUARD, GUARD_ACTIONS, SIDE_EFFECT, SIGNAL_REFS, SIGNAL_WEIGHT, STEP_ORDER, TAINT_WORDS, VALIDATION_WORDS,
)
from weftline.functions.patterns import PATTERNS

Pattern = tuple[tuple[str, ...], str, str, str]


def signal_weight(signal: Column | str, weights: dict[str, float] = SIGNAL_WEIGHT) -> Column:
    signal = F.col(signal) if isinstance(signal, str) else signal
    return F.coalesce(F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, w)))[signal], F.lit(0.0))


def match_lines(lines: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """(node, file, signal, start, stop, reason): a row for each pattern that a line of lines(node, file, language, lineno, text) shows.

    Patterns are literals of one projection, compiled once a task; a line is
    tried against its language's patterns only, and no join takes place.
    """
    tests = [
        F.when(F.col("language").isin(*languages) & F.col("text").rlike(expression), F.struct(F.lit(signal).alias("signal"), F.lit(reason).alias("reason")))
        for languages, signal, expression, reason in (PATTERNS if patterns is None else patterns)
    ]
    hits = lines.withColumn("hit", F.explode(F.array_compact(F.array(*tests))))
    return hits.select("node", "file", "hit.signal", F.col("lineno").alias("start"), F.col("lineno").alias("stop"), "hit.reason")


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | text.contains(w)
    return test


def looks_like_validation(text: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    comparison = r"""(==|!=)\s*(None|null|undefined|""|''|0\b|False\b|True\b)"""
    more = low.contains(" is none") | low.contains(" is not none") | text.rlike(comparison) | text.contains("<=") | text.contains(">=")
    return _contains_any(low, VALIDATION_WORDS) | text.rlike(r"\bif\s*\(\s*!") | more


def guard_windows(lines: DataFrame, look: int = 2, when: str = r"\bif\b") -> DataFrame:
    """(node, file, signal, start, stop, reason): a line with `if` and, among it and the next `look` own lines, one that leaves.

    The window counts a node's own lines, not line numbers. A word of rights
    anywhere in it makes an auth guard, else a validation test a validation
    guard. The guard ends at the line that leaves.
    """
    own = Window.partitionBy("node").orderBy("lineno")
    rows = lines.withColumn("w", F.collect_list(F.struct("lineno", "text")).over(own.rowsBetween(0, look)))
    rows = rows.where(F.col("text").rlike(when))
    leaving = F.filter("w", lambda x: _contains_any(F.lower(x["text"]), GUARD_ACTIONS))
    rows = rows.where(F.size(leaving) > 0)
    whole = F.array_join(F.transform("w", lambda x: x["text"]), " ")
    signal = F.when(_contains_any(F.lower(whole), AUTH_WORDS), "auth_guard").when(looks_like_validation(whole), "validation_guard")
    rows = rows.select("node", "file", signal.alias("signal"), F.col("lineno").alias("start"), F.get(leaving, F.lit(0))["lineno"].alias("stop"))
    reason = F.when(F.col("signal") == "auth_guard", "leaves unless rights allow").otherwise("leaves on bad input")
    return rows.where("signal is not null").withColumn("reason", reason)


def top_refs(refs: DataFrame, limit: int = SIGNAL_REFS) -> DataFrame:
    """Each node's first `limit` distinct refs by weight (descending), start, stop, signal, reason, with their rank."""
    order = Window.partitionBy("node").orderBy(F.desc(signal_weight("signal")), "start", "stop", "signal", "reason")
    return refs.select("node", "file", "signal", "start", "stop", "reason").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def evidence(refs: DataFrame, dynamic: DataFrame | None = None, limit: int = SIGNAL_REFS) -> DataFrame:
    """The refs of nodes after all rules, with rank.

    dynamic(node, file, start, n): nodes that n string references name; they
    get a dynamic_dispatch ref. The list is cut to the limit first; the
    strongest reference to the outside then gives an external_io ref, and the
    list is cut again.
    """
    if dynamic is not None:
        extra = dynamic.select("node", "file", F.lit("dynamic_dispatch").alias("signal"), "start", F.col("start").alias("stop"), F.concat(F.lit("named by "), F.col("n").cast("string"), F.lit(" string references")).alias("reason"))
        refs = refs.unionByName(extra)
    kept = top_refs(refs, limit)
    outside = kept.groupBy("node").agg(
        F.min(F.when(F.col("signal").isin(*EXTERNAL_IO), F.struct("rank", "file", "signal", "start", "stop"))).alias("o"), F.max(F.when(F.col("signal") == "external_io", 1)).alias("has")
    )
    derived = outside.where("o is not null and has is null")
    derived = derived.select("node", "o.file", F.lit("external_io").alias("signal"), "o.start", "o.stop", F.concat(F.lit("reaches outside by "), F.col("o.signal")).alias("reason"))
    return top_refs(kept.drop("rank").unionByName(derived), limit)


def node_signals(refs: DataFrame) -> DataFrame:
    """(node, signals, weight, n_refs, families): distinct signals by weight and name, their summed weight, their families."""
    one = refs.groupBy("node", "signal").agg(F.count("*").alias("n"))
    per = one.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-signal_weight("signal")).alias("w"), "signal"))).alias("s"), F.sum("n").alias("n_refs"))
    names = F.transform("s", lambda x: x["signal"])
    family = lambda name, members: F.when(F.size(F.array_intersect(names, F.array(*map(F.lit, members)))) > 0, F.lit(name))
    families = F.array_compact(F.array(family("side_effect", SIDE_EFFECT), family("boundary", BOUNDARY), family("guard", GUARD)))
    weight = F.round(-F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"]), 2)
    return per.select("node", names.alias("signals"), weight.alias("weight"), "n_refs", F.array_join(families, ",").alias("families"))


def contained_rollup(refs: DataFrame, children: DataFrame, limit: int = SIGNAL_REFS) -> DataFrame:
    """(outer, signals, weight, n_children): what the nodes within a container do, from children(outer, inner)."""
    found = children.join(refs.withColumnRenamed("node", "inner"), "inner")
    count = found.groupBy("outer").agg(F.count_distinct("inner").alias("n_children"))
    kept = top_refs(found.withColumnRenamed("outer", "node"), limit)
    return node_signals(kept).select(F.col("node").alias("outer"), "signals", "weight").join(count, "outer")


def flow_steps(refs: DataFrame, nodes: DataFrame, limit: int = 12) -> DataFrame:
    """(node, step, signal, start, stop): the steps of executable nodes(node, kind, start) in order.

    Signals that are steps, without an output on the node's first line that
    only names a response object; ordered by start, stop and the steps' own
    order; repeats of (signal, start, stop) once; the first `limit` count. Of
    these an output before the earliest side effect is left out where another
    step is on its lines. Neighbours of one kind are kept, compact joins them.
    """
    runs = nodes.where(F.col("kind").isin(*EXECUTABLE_KINDS)).select("node", F.col("start").alias("first"))
    rank = F.create_map(*(F.lit(x) for k, v in STEP_ORDER.items() for x in (k, v)))[F.col("signal")]
    output = F.col("signal") == "output_boundary"
    named = output & (F.col("start") <= F.col("first")) & F.lower(F.coalesce("reason", F.lit(""))).contains("response object")
    steps = refs.join(runs, "node").withColumn("k", rank).where(F.col("k").isNotNull() & ~named)
    steps = steps.select("node", "signal", "start", "stop", "k").distinct()
    order = Window.partitionBy("node").orderBy("start", "stop", "k", "signal")
    steps = steps.withColumn("step", F.row_number().over(order)).where(F.col("step") <= limit)
    effect = F.min(F.when(F.col("signal").isin(*SIDE_EFFECT), F.col("start"))).over(Window.partitionBy("node"))
    others = F.count(F.when(~output, 1)).over(Window.partitionBy("node", "start", "stop"))
    steps = steps.withColumns({"effect": effect, "others": others})
    steps = steps.where(~(output & F.coalesce(F.col("start") < F.col("effect"), F.lit(False)) & (F.col("others") > 0)))
    return steps.withColumn("step", F.row_number().over(Window.partitionBy("node").orderBy("step"))).select("node", "step", "signal", "start", "stop")


def compact(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """The rows whose value differs from the one before in their group's order."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def flow_summary(steps: DataFrame) -> DataFrame:
    """(node, path, boundary_first, ends_in_output, handles_errors): compacted steps as one line, and what they tell."""
    lean = compact(steps, "node", ["step"], "signal")
    first = lambda names: F.min(F.when(F.col("signal").isin(*names), F.col("step")))
    out = lean.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("step", "signal"))).alias("s"), first(("input_boundary",)).alias("b"), first(SIDE_EFFECT).alias("e"), F.max(F.col("signal") == "error_handling").alias("handles_errors")
    )
    names = F.transform("s", lambda x: x["signal"])
    return out.select(
        "node",
        F.array_join(names, " -> ").alias("path"),
        F.coalesce(F.col("b") < F.col("e"), F.lit(False)).alias("boundary_first"),
        (F.element_at(names, -1) == "output_boundary").alias("ends_in_output"),
        "handles_errors",
    )


def arch_rules(nodes: DataFrame) -> DataFrame:
    """(node, rule, severity) of nodes(node, signals array, reachable array): own signals, and guards of callers.

    Nothing fires for a node without signals of its own.
    """
    own = lambda s: F.array_contains("signals", s)
    every = lambda s: own(s) | F.coalesce(F.array_contains("reachable", s), F.lit(False))
    rules = [
        ("unguarded_entry", "critical", own("input_boundary") & ~every("auth_guard") & ~every("validation_guard")),
        ("untrusted_deserialization", "critical", own("deserialization") & ~every("validation_guard")),
        ("concurrent_mutation", "high", own("concurrency") & own("state_mutation") & ~own("error_handling")),
        ("cache_coherence_risk", "high", own("caching") & own("state_mutation") & own("concurrency")),
        ("open_network_call", "high", own("network_io") & ~every("error_handling")),
        ("unguarded_db_write", "high", own("database_io") & own("state_mutation") & ~every("auth_guard")),
        ("double_indirection", "medium", own("orm_dynamic_load") & own("dynamic_dispatch")),
        ("stateful_input_boundary", "medium", own("input_boundary") & own("state_mutation") & ~own("validation_guard")),
    ]
    fired = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, severity, test in rules)))
    return nodes.where(F.size("signals") > 0).select("node", F.explode(fired).alias("r")).select("node", "r.*")


def taint_sources(nodes: DataFrame) -> DataFrame:
    """(node, sources, tainted): kinds of outside input of executable nodes(node, kind, language, text, decorators, params, exported, hooked), first kind first.

    Python code by words and decorators, a `main` that reads arguments and
    hooked functions; parameters of exported JavaScript functions. tainted maps
    each parameter but self and cls to the first kind.
    """
    text, decorators = F.coalesce("text", F.lit("")), F.array_join("decorators", " ")
    shown = {k: _contains_any(text, words) for k, words in TAINT_WORDS.items()}
    routed = decorators.rlike(r"route|\.(get|post|put|delete|patch)\b|whitelist")
    shown["http_param"] = shown["http_param"] | routed | (F.col("language").isin("javascript", "typescript") & F.col("exported") & (F.size("params") > 0))
    shown["cli_arg"] = shown["cli_arg"] | decorators.rlike(r"\bclick\.|\bcommand\b")
    shown["event_hook"] = shown["event_hook"] | F.coalesce("hooked", F.lit(False))
    found = F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in shown.items())))
    rows = nodes.where(F.col("kind").isin(*EXECUTABLE_KINDS)).withColumn("sources", found).where(F.size("sources") > 0)
    named = F.filter("params", lambda p: ~p.isin("self", "cls"))
    return rows.select("node", "sources", F.map_from_arrays(named, F.transform(named, lambda _: F.get("sources", F.lit(0)))).alias("tainted"))
