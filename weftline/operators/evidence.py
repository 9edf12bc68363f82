"""What is worth reading next: signal-bearing nodes, watch rules, overviews, priorities, gaps, escalation and follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.constants import BOUNDARY, CRITICAL, EXTERNAL_IO, GUARD, OUTCOME_ORDER, SIDE_EFFECT
from weftline.operators.retrieve import escalation_cost
from weftline.operators.signals import signal_weight


def has_any(signals: Column | str, names: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(signals, F.array(*map(F.lit, names)))) > 0


def _named(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))


def signal_candidates(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(node, score, why, rank) of nodes(node, kind, signals, weight, risk, ambiguous) with signals: the shadowed ones are left out before.

    Three times the weight, risk / 12 up to 8, 3 for a boundary, 2 for what
    reaches outside, 1 less for a module. Order: score, weight, risk, name.
    """
    c = F.col
    score = 3 * c("weight") + F.least(c("risk") / 12, F.lit(8.0)) + F.when(has_any("signals", BOUNDARY), 3.0).otherwise(0.0) + F.when(has_any("signals", EXTERNAL_IO), 2.0).otherwise(0.0) - F.when(c("kind") == "module", 1.0).otherwise(0.0)
    why = _named([("boundary", has_any("signals", BOUNDARY)), ("side_effect", has_any("signals", SIDE_EFFECT)), ("guard", has_any("signals", GUARD)), ("structural_risk", c("risk") >= 45), ("ambiguous", c("ambiguous"))])
    why = F.when(F.size(why) == 0, F.array(F.lit("signal"))).otherwise(why)
    rows = nodes.where(F.size("signals") > 0).withColumn("score", F.round(score, 2)).withColumn("why", why)
    order = [F.desc("score"), F.desc("weight"), F.desc("risk"), "node"]
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("node", "score", "why", "rank")  # at most `limit` rows


def watchlist(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """(node, why) of nodes(node, signals, weight, risk, ambiguous) that a watch rule names; by weight, risk, name."""
    c = F.col
    own = lambda s: F.array_contains("signals", s)
    outside = has_any("signals", EXTERNAL_IO)
    why = _named(
        [
            ("ambiguous_and_critical", c("ambiguous") & has_any("signals", CRITICAL)),
            ("mutation_with_outside_effects", own("state_mutation") & outside),
            ("rights_on_a_boundary", own("auth_guard") & (outside | own("input_boundary"))),
            ("effects_rely_on_error_handling", own("error_handling") & outside),
            ("process_execution", own("process_io")),
        ]
    )
    rows = nodes.withColumn("why", why).where(F.size("why") > 0)
    return rows.orderBy(F.desc("weight"), F.desc("risk"), "node").limit(limit).select("node", "why")


def signal_entrypoints(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """(node, signals) of the nodes at a boundary, reaching outside or guarding; by weight, risk, name."""
    rows = nodes.where(has_any("signals", (*BOUNDARY, *EXTERNAL_IO, "auth_guard", "validation_guard")))
    return rows.orderBy(F.desc("weight"), F.desc("risk"), "node").limit(limit).select("node", "signals")


def nodes_by_signal(nodes: DataFrame) -> DataFrame:
    """(signal, n): nodes that show each signal."""
    return nodes.select("node", F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def files_by_weight(refs: DataFrame, limit: int = 8) -> DataFrame:
    """(file, signals, weight, n_nodes): the files whose evidence refs(node, file, signal) weighs most, each signal once."""
    one = refs.groupBy("file", "signal").agg(F.count("*").alias("n"))
    per = one.groupBy("file").agg(F.sort_array(F.collect_list(F.struct((-signal_weight("signal")).alias("w"), "signal"))).alias("s"))
    count = refs.groupBy("file").agg(F.count_distinct("node").alias("n_nodes"))
    weight = F.round(-F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"]), 2)
    out = per.select("file", F.transform("s", lambda x: x["signal"]).alias("signals"), weight.alias("weight")).join(count, "file")
    return out.orderBy(F.desc("weight"), F.desc("n_nodes"), "file").limit(limit)


def signal_bonus(rows: DataFrame) -> Column:
    """What signals add to a priority, for rows(signals, weight, ambiguous, kind): 0 without signals, never negative."""
    c = F.col
    critical = has_any("signals", CRITICAL)
    bonus = 1.7 * c("weight") + F.when(has_any("signals", BOUNDARY), 4.0).otherwise(0.0) + F.when(critical, 2.0).otherwise(0.0) + F.when(c("ambiguous") & critical, 1.5).otherwise(0.0) - F.when(c("kind") == "module", 1.0).otherwise(0.0)
    return F.when(F.size("signals") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), bonus), 2))


def evidence_priority(rows: DataFrame) -> DataFrame:
    """rows(risk, best_score, degree, n_ambiguous, signals, weight, kind) with priority: risk, ten times the best edge's score, the degree up to 6, the signals' bonus, less four for each ambiguous call."""
    rows = rows.withColumn("ambiguous", F.col("n_ambiguous") > 0)
    value = F.col("risk") + 10 * F.coalesce("best_score", F.lit(0.0)) + F.least(F.lit(6.0), F.col("degree")) + signal_bonus(rows) - 4 * F.col("n_ambiguous")
    return rows.withColumn("priority", F.round(value, 2))


def merge_groups(groups: DataFrame) -> DataFrame:
    """(anchor, role, symbols, refs, score): groups(anchor, role, symbols array, refs array, score) with one anchor and role as one, sets united, the best score kept."""
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return groups.groupBy("anchor", "role").agg(sets("symbols"), sets("refs"), F.max("score").alias("score"))


def flow_gaps(rows: DataFrame, limit: int = 4) -> DataFrame:
    """(id, node, missing) of rows(id, node, wanted, shown: arrays): wanted signals without a step, the largest gaps of an id first."""
    out = rows.withColumn("missing", F.array_except("wanted", "shown")).where(F.size("missing") > 0)
    order = Window.partitionBy("id").orderBy(F.desc(F.size("missing")), "node")
    return out.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select("id", "node", "missing")


def open_sequence(rows: DataFrame, limit: int = 4) -> DataFrame:
    """(id, refs) of rows(id, source, position, ref): the first distinct refs by source and position."""
    first = rows.groupBy("id", "ref").agg(F.min(F.struct("source", "position")).alias("at"))
    order = Window.partitionBy("id").orderBy("at", "ref")
    kept = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)
    return kept.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ref"))), lambda x: x["ref"]).alias("refs"))


def escalations(rows: DataFrame) -> DataFrame:
    """rows with cost, gain, expected, blocked_by, allowed and confidence: whether reading more is worth it.

    rows(outcome, request, signals, wanted, missing: arrays, targets, lines,
    files, n_gaps, n_ambiguous): a request is `ambiguity`, `symbol` or another
    follow-up. Of an ambiguous result only what tells candidates apart helps;
    else new signals lead to a confirmed result if they are all that is
    missing, to a partial one if not.
    """
    c = F.col
    out = escalation_cost(rows).withColumn("gain", F.array_sort(F.array_intersect("signals", "wanted")))
    gains, apart = F.size("gain") > 0, c("request") == "ambiguity"
    all_missing = (F.size("missing") > 0) & (F.size(F.array_except("missing", "gain")) == 0)
    nothing_open = (F.size("missing") == 0) & (c("n_gaps") == 0)
    expected = (
        F.when(apart & (c("outcome") == "ambiguous"), F.when(nothing_open, "confirmed").otherwise("partial"))
        .when(apart, F.lit(None).cast("string"))
        .when(gains & (c("outcome") == "partial"), F.when(all_missing, "confirmed").otherwise("partial"))
        .when(gains & (c("outcome") == "unproven"), F.when(all_missing & (c("n_ambiguous") == 0), "confirmed").otherwise("partial"))
        .when(~gains & (c("request") == "symbol") & (c("outcome") == "partial") & (F.size("missing") == 0), "confirmed")
    )
    out = out.withColumn("expected", expected)
    blocked = _named(
        [
            ("already_confirmed", c("outcome") == "confirmed"),
            ("nothing_to_read", c("targets") == 0),
            ("only_disambiguation_helps", (c("outcome") == "ambiguous") & ~apart),
            ("no_better_outcome", c("expected").isNull() | (c("expected") == c("outcome"))),
            ("cost_exceeds_gain", (c("cost") == "high") & (F.coalesce("expected", F.lit("")) != "confirmed")),
        ]
    )
    out = out.withColumn("blocked_by", blocked).withColumn("allowed", F.size("blocked_by") == 0)
    trust = F.when(~c("allowed"), "low").when((c("expected") == "confirmed") & (c("cost") == "low") & gains, "high").when(c("expected").isin("confirmed", "partial") & c("cost").isin("low", "medium"), "medium").otherwise("low")
    return out.withColumn("confidence", trust)


def rank_escalations(rows: DataFrame, limit: int = 4) -> DataFrame:
    """The first options of each id of escalations(id, option): allowed ones first, then the better outcome, the lower cost, the surer one."""
    level = lambda c, names: F.create_map(*(F.lit(x) for k, v in enumerate(names) for x in (v, k)))[F.col(c)]
    outcome = F.coalesce(F.create_map(*(F.lit(x) for k, v in OUTCOME_ORDER.items() for x in (k, v)))[F.col("expected")], F.lit(-1))
    order = Window.partitionBy("id").orderBy(F.desc("allowed"), F.desc(outcome), level("cost", ("low", "medium", "high")), F.desc(level("confidence", ("low", "medium", "high"))), "option")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def followup_kind(rows: DataFrame) -> DataFrame:
    """rows(request, gain, closes_gap) with kind: what a follow-up is for."""
    c = F.col
    kind = (
        F.when(c("request") == "ambiguity", "ambiguity_resolution")
        .when(c("closes_gap"), "flow_gap_check")
        .when(F.size("gain") > 0, "semantic_confirmation")
        .when(c("request") == "path", "path_completion")
        .otherwise("focused_symbol_check")
    )
    return rows.withColumn("kind", kind)


def followup_budget(rows: DataFrame) -> DataFrame:
    """rows(cost, lines, targets, files) with line_budget, slice_budget and file_budget.

    Lines asked for and 2, 4 or 6 more, within 8 to 12, 12 to 24 or 18 to 40 by
    cost; one, two or three slices and files at most.
    """
    c = F.col

    def by_cost(low: Column, medium: Column, high: Column) -> Column:
        return F.when(c("cost") == "low", low).when(c("cost") == "medium", medium).otherwise(high)

    within = lambda more, least, most: F.greatest(F.lit(least), F.least(F.lit(most), c("lines") + more))
    most = by_cost(F.lit(1), F.lit(2), F.lit(3))
    some = lambda n: F.least(most, F.greatest(F.lit(1), c(n)))
    return rows.withColumns({"line_budget": by_cost(within(2, 8, 12), within(4, 12, 24), within(6, 18, 40)), "slice_budget": some("targets"), "file_budget": some("files")})


def flow_chains(paths: DataFrame, flows: DataFrame, limit: int = 4) -> DataFrame:
    """(id, path, chain, n_flows, complete) of paths(id, path, position, node) and flows(node, steps array): the steps along each path.

    Output before the last node of a path is left out, neighbours of one kind
    are joined. A chain is complete if every node of the path has steps; of an
    id the complete ones go first, then those with more flows, then by path.
    """
    last = Window.partitionBy("id", "path")
    rows = paths.withColumn("last", F.max("position").over(last)).join(flows, "node", "left")
    inner = F.filter(F.coalesce("steps", F.array().cast("array<string>")), lambda s: (s != "output_boundary") | (F.col("position") == F.col("last")))
    rows = rows.withColumn("own", inner).groupBy("id", "path").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "own"))), lambda x: x["own"])).alias("all"), F.count("steps").alias("n_flows"), (F.count("steps") == F.count("*")).alias("complete")
    )
    joined = F.filter("all", lambda s, k: (k == 0) | (F.get("all", k - 1) != s))
    rows = rows.where("n_flows > 0").withColumn("chain", F.array_join(joined, " -> "))
    order = Window.partitionBy("id").orderBy(F.desc("complete"), F.desc("n_flows"), "path")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select("id", "path", "chain", "n_flows", "complete")


def ordered_nodes(edges: DataFrame) -> DataFrame:
    """(id, nodes) of the few edges(id, position, src, dst) of each path: from a node that none leads to along the edges, then what is left.

    A path has a handful of edges, so each is one row's fold: the start is the
    first source without predecessor, else the first source; an edge whose
    source is the last node so far appends its end; ends not reached follow in
    the order of the edges.
    """
    per = edges.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", "src", "dst"))).alias("e"))
    ends = F.transform("e", lambda x: x["dst"])
    roots = F.filter(F.transform("e", lambda x: x["src"]), lambda s: ~F.array_contains(ends, s))
    start = F.array(F.coalesce(F.get(roots, F.lit(0)), F.get("e", F.lit(0))["src"]))

    def follow(a: Column, x: Column) -> Column:
        return F.when((x["src"] == F.element_at(a, -1)) & ~F.array_contains(a, x["dst"]), F.array_append(a, x["dst"])).otherwise(a)

    once = F.aggregate("e", start, follow)
    walked = F.aggregate("e", once, follow)  # a second pass takes edges listed before the one that leads to them
    rest = F.flatten(F.transform("e", lambda x: F.array(x["src"], x["dst"])))
    return per.select("id", F.array_distinct(F.concat(walked, rest)).alias("nodes"))
