"""Evidence for a question about a source tree, under a budget of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.constants import COMPLETION_STATES, OUTCOME_ORDER
from weftline.operators import evidence, graph, intervals, retrieve, risk, signals
from weftline.plans.analysis import Analysis

#: The share of the budget for the best candidates; what supports them may use the rest.
PRIMARY = 0.72


def _candidate_nodes(a: Analysis) -> DataFrame:
    support = graph.support_edges(a.edges.select("src", "dst", F.col("kinds").alias("kind"), "score"), 1).select("node", F.col("score").alias("support"))
    inside = a.children.join(a.signals.select(F.col("node").alias("inner"), "signals"), "inner").groupBy(F.col("outer").alias("node")).agg(F.array_distinct(F.flatten(F.collect_list("signals"))).alias("contained"))
    open_ = a.resolved.where("kind = 'ambiguous_candidates'").select("node").distinct().withColumn("ambiguous", F.lit(True))
    leads = a.edges.where("src <> dst").select(F.col("src").alias("node"), F.lit(True).alias("leads")).distinct()
    none = F.array().cast("array<string>")
    out = a.metrics.join(a.nodes.select("node", F.col("qualname").alias("name")), "node").join(support, "node", "left").join(inside, "node", "left").join(open_, "node", "left").join(leads, "node", "left")
    return out.select("node", "name", "file", "kind", "risk", "signals", F.coalesce("contained", none).alias("contained"), F.coalesce("support", F.lit(0.0)).alias("support"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("leads", F.lit(False)).alias("leads"), "start_line", "end_line")


def ambiguities(a: Analysis, limit: int = 12) -> DataFrame:
    """(node, raw, options) of ambiguous calls, the riskiest nodes first."""
    rows = a.resolved.where("kind = 'ambiguous_candidates'").join(a.metrics.select("node", "risk"), "node")
    return rows.orderBy(F.desc("risk"), "node", "raw").limit(limit).select("node", "raw", "options")


def evidence_paths(a: Analysis, nodes: DataFrame) -> DataFrame:
    """(id, path, confidence, position, node): the paths of one or two edges that start at nodes(node), a row a node of a path.

    Only the edges of the nodes and of those next to them are looked at.
    """
    edges = a.edges.select("src", "dst", "score")
    first = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    then = edges.join(first.select(F.col("dst").alias("src")), "src", "left_semi")
    paths = graph.two_hop_paths(first.unionByName(then).distinct()).join(nodes.select("node"), "node", "left_semi")
    parts = F.posexplode(F.split("path", " -> ")).alias("position", "node")
    return paths.select(F.lit("q").alias("id"), "path", "confidence", parts)


def flow_states(steps: DataFrame, spans: DataFrame, primary: DataFrame, slices: DataFrame) -> DataFrame:
    """(node, completeness) of flow steps(node, signal, start, stop): how many of a node's steps lie in primary, and in all, slices(file, start, stop)."""
    rows = steps.join(spans.select("node", "file"), "node").select("node", "file", "start", "stop").distinct()
    ref = F.concat_ws("-", "start", "stop")
    refs_of = lambda df, name: df.groupBy("node").agg(F.collect_set(ref).alias(name))
    out = refs_of(rows, "wanted")
    for name, within in (("direct", primary), ("context", slices)):
        out = out.join(refs_of(intervals.covered(rows, within), name), "node", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return retrieve.completeness(out).select("node", "completeness")


def ask(a: Analysis, question: str, budget: int = 110, limit: int = 10) -> dict:
    """What the question asks for, who matches it, the slices to read in order, the flows among them and what may honestly be said.

    Slices are the evidence of the ranked symbols, one line more on both sides,
    or their span; the first is always taken, then those that fit into the
    primary share of the budget, then supporting ones up to all of it; a slice
    that does not fit is deferred. Taken slices of one file that touch merge.
    """
    spark = a.spark
    budget = max(20, budget)
    asked = retrieve.analyse_questions(spark.createDataFrame([("q", question)], "id string, question string"))
    info = asked.first().asDict()
    nodes = a._table(_candidate_nodes(a), f"ask{abs(hash(question))}")
    forms = a.nodes.select("node", F.array("qualname", F.element_at(F.split("qualname", r"\."), -1), "node", F.regexp_replace(F.regexp_replace("file", "^.*/", ""), r"\.[^.]*$", "")).alias("forms"), "kind", (F.col("end_line") - F.col("start_line")).alias("span"))
    named = a._table(retrieve.mentions(asked, forms), f"named{abs(hash(question))}")
    named_files = a._table(retrieve.file_mentions(asked, a.nodes.select("file")), f"files{abs(hash(question))}")
    mentioned = [r["node"] for r in named.orderBy("rank").collect()]
    ranked = a._table(retrieve.rank_candidates(asked, nodes, limit, named, named_files), f"ranked{abs(hash(question))}")
    wanted = info["signals"]
    best = ranked.join(nodes.drop("signals", "contained"), "node").select("node", "file", "start_line", "end_line", "score", "rank", "ambiguous")
    refs = a.refs.join(best.select("node"), "node")
    hits = refs.where(F.col("signal").isin(*wanted)) if wanted else refs
    hull = hits.groupBy("node").agg(F.min("start").alias("s"), F.max("stop").alias("e"))
    last = a.nodes.groupBy("file").agg(F.max("end_line").alias("last"))
    primary = best.join(hull, "node", "left").join(last, "file")
    primary = primary.select("node", "file", F.coalesce(F.greatest(F.lit(1), F.col("s") - 1), "start_line").alias("start"), F.coalesce(F.least("last", F.col("e") + 1), "end_line").alias("stop"), "score", F.lit(0).alias("role"), "rank")
    near = graph.support_edges(a.edges.select("src", "dst", F.col("kinds").alias("kind"), "score"), 2).join(best.select("node", F.col("rank").alias("of")), "node")
    near = near.join(best.select(F.col("node").alias("other")), "other", "left_anti").join(a.nodes.select(F.col("node").alias("other"), "file", "start_line", "end_line"), "other")
    support = near.select(F.col("other").alias("node"), "file", F.col("start_line").alias("start"), F.col("end_line").alias("stop"), F.col("score").cast("double").alias("score"), F.lit(1).alias("role"), "of").dropDuplicates(["node"]).withColumnRenamed("of", "rank")
    pool = primary.unionByName(support).withColumn("key", F.concat_ws("|", "role", "node")).withColumn("lines", F.col("stop") - F.col("start") + 1).withColumn("q", F.lit("q"))
    first = retrieve.within_budget(pool.where("role = 0"), "q", ["rank", "node"], "lines", budget, first=1, share=PRIMARY)
    used = first.where("taken").agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    second = retrieve.within_budget(pool.where("role = 1"), "q", [F.desc("score"), "rank", "node"], "lines", max(0, budget - used), first=0)
    chosen = first.unionByName(second)
    slices = intervals.merge_slices(chosen.where("taken").select("file", "start", "stop", F.col("node").alias("name"), F.col("score")))
    direct = chosen.where("taken and role = 0").select("node")
    flows = a.flows.join(direct, "node").orderBy("node").collect()
    covered = {r["signal"] for r in refs.join(direct, "node").select("signal").distinct().collect()}
    steps = a._table(signals.flow_steps(a.refs.join(best.select("node"), "node", "left_semi"), a.spans.select("node", "kind", "start")), f"steps{abs(hash(question))}")
    whole = chosen.where("taken")
    state = {r["node"]: r["completeness"] for r in flow_states(steps, a.spans, whole.where("role = 0").select("file", "start", "stop"), whole.select("file", "start", "stop")).collect()}
    some = len(set(wanted) & covered)
    states = [("q", state.get(r["node"], "missing"), some, len(wanted)) for r in flows if not wanted or some] or [("q", "context_only" if direct.count() else "missing", some, len(wanted))]
    if wanted and not set(wanted) <= covered:
        states = [(i, "partial" if s == "complete" else s, k, n) for i, s, k, n in states]
    paths = a._table(evidence_paths(a, best.select("node")), f"paths{abs(hash(question))}")
    along = a.refs.join(paths.select("node").distinct(), "node", "left_semi")
    taken = signals.flow_steps(along, a.spans.select("node", "kind", "start"))
    flow = taken.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "signal"))), lambda x: x["signal"]).alias("steps"))
    chains = evidence.flow_chains(paths, flow).orderBy(F.desc("complete"), F.desc("n_flows"), "path").collect()
    asked_for = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    shown = steps.groupBy("node").agg(F.collect_set("signal").alias("shown"))
    gaps = evidence.flow_gaps(shown.select(F.lit("q").alias("id"), "node", asked_for.alias("wanted"), "shown")).orderBy(F.desc(F.size("missing")), "node").collect()
    unclear = [r.asDict() for r in ambiguities(a).join(best.select("node"), "node").collect()] if "ambiguity_resolution" in info["intents"] else []
    outcome = retrieve.outcome_mode(spark.createDataFrame(states, "id string, completeness string, covered int, wanted int"), spark.createDataFrame([("q",)] * bool(unclear), "id string")).first()["outcome"]
    deferred = [r.asDict() for r in chosen.where("not taken").orderBy("role", "rank", "node").select("node", "file", "start", "stop").limit(6).collect()]
    out = {
        "question": question,
        "intents": info["intents"],
        "signals": wanted,
        "scope": info["scope"],
        "mentions": mentioned,
        "candidates": [r.asDict() for r in best.orderBy("rank").select("node", "score", "file").collect()],
        "slices": [r.asDict() for r in slices.orderBy(F.desc("score"), "file", "start").collect()],
        "flows": {r["node"]: r["path"] for r in flows},
        "completeness": state,
        "mentioned_files": [r["file"] for r in named_files.orderBy("rank").collect()],
        "paths": [r.asDict() for r in paths.select("path", "confidence").distinct().orderBy(F.desc("confidence"), "path").limit(6).collect()],
        "chains": [{"path": r["path"], "chain": r["chain"], "complete": r["complete"]} for r in chains],
        "gaps": [{"node": r["node"], "missing": r["missing"]} for r in gaps],
        "missing_signals": sorted(set(wanted) - covered),
        "ambiguities": unclear,
        "deferred": deferred,
        "outcome": outcome,
    }
    found = refs.where(F.col("signal").isin(*(wanted or ["*"]))).orderBy("node", "start", "signal").limit(12)
    out["evidence"] = [f"{r['file']}:{r['start']}-{r['stop']}#{r['signal']}" for r in found.collect()]
    out["contract"] = contract_of(out)
    out["plan"] = plan_of(out)
    out["result"] = result_of(out)
    out["escalation"] = escalation_of(a, out, refs)
    out["followup"] = followup_of(out)
    out["packet"] = packet_of(out)
    out["prompt"] = prompt_of(out)
    return out


def contract_of(answer: dict) -> dict:
    """What a worker that reads the slices may claim, and when it has to stop."""
    refs = [f"{s['file']}:{s['start']}-{s['stop']}" for s in answer["slices"]]
    claims = [f"{node}: {path}" for node, path in sorted(answer["flows"].items())] or [f"{c['node']} is relevant" for c in answer["candidates"][:3]]
    floor = min(answer["outcome"], "partial", key=OUTCOME_ORDER.__getitem__)
    return {
        "allowed_claims": claims,
        "disallowed_claims": ["the evidence is complete"] if answer["missing_signals"] else [],
        "required_read_order_refs": refs[:4],
        "required_primary_symbols": [c["node"] for c in answer["candidates"][:1]],
        "valid_stop_conditions": ["all required slices read", "evidence is ambiguous", "evidence is missing"],
        "supported_states": list(COMPLETION_STATES),
        "rules": ["must_not_claim_uniqueness_while_ambiguous"] if answer["ambiguities"] else [],
        "expected_ceiling": answer["outcome"],
        "minimum_honest": floor,
        "followup_allowed": bool(answer["deferred"]) and answer["outcome"] != "confirmed",
    }


def _ref(x: dict) -> str:
    return f"{x['file']}:{x['start']}-{x['stop']}"


def plan_of(answer: dict) -> dict:
    """Up to four slices to open, what to look for in each, and when to stop; then the answer."""
    steps = [{"step": k, "open": _ref(x), "symbols": x["names"], "look_for": answer["signals"] or ["what the symbols do"]} for k, x in enumerate(answer["slices"][:4], 1)]
    steps.append({"step": len(steps) + 1, "open": "", "symbols": "", "look_for": ["an answer within the contract"]})
    decisions = [f"go on to the next slice unless it shows {', '.join(answer['signals'])}"] if answer["signals"] else []
    if answer["ambiguities"]:
        decisions.append("do not choose between the candidates of an ambiguous call")
    if answer["missing_signals"]:
        decisions.append(f"say that {', '.join(answer['missing_signals'])} was not found")
    return {"goal": " and ".join(answer["intents"]) or "find what the question names", "steps": steps, "decisions": decisions, "stop": answer["contract"]["valid_stop_conditions"]}


def result_of(answer: dict) -> dict:
    """What may be said now: a claim no stronger than the outcome, its evidence and its limits."""
    names = ", ".join(x["node"] for x in answer["candidates"][:3]) or "no symbol"
    claim = {
        "confirmed": f"{names}: the evidence shows what the question asks for.",
        "partial": f"{names}: the evidence shows a part of what the question asks for.",
        "ambiguous": f"{names}: several candidates fit and the evidence does not choose between them.",
        "unproven": f"{names}: related by name or structure alone.",
    }[answer["outcome"]]
    posture = {"confirmed": "firm", "partial": "qualified", "ambiguous": "open", "unproven": "tentative"}[answer["outcome"]]
    limits = [f"no evidence of {s}" for s in answer["missing_signals"]] + [f"ambiguous call {x['raw']} in {x['node']}" for x in answer["ambiguities"]] + [f"not read: {_ref(x)}" for x in answer["deferred"]]
    return {"outcome": answer["outcome"], "claim": claim, "posture": posture, "evidence": answer["evidence"], "basis": [_ref(x) for x in answer["slices"][:2]], "limits": limits}


_OPTION = "id string, option string, outcome string, request string, signals array<string>, wanted array<string>, missing array<string>, targets int, lines int, files int, n_gaps int, n_ambiguous int"


def escalation_of(a: Analysis, answer: dict, refs: DataFrame) -> list[dict]:
    """The first four requests for more reading, with cost, gain and why they are refused: deferred slices, missing signals elsewhere, ambiguous calls."""
    rows = []
    common = (answer["signals"], answer["missing_signals"])
    shows = {r["node"]: r["signals"] for r in a.signals.where(F.col("node").isin(*[x["node"] for x in answer["deferred"]] or [""])).collect()}
    for x in answer["deferred"]:
        rows.append(("q", f"read {_ref(x)}", answer["outcome"], "symbol", list(shows.get(x["node"], [])), *common, 1, x["stop"] - x["start"] + 1, 1, len(answer["missing_signals"]), len(answer["ambiguities"])))
    for signal in answer["missing_signals"]:
        first = a.refs.where(F.col("signal") == signal).join(refs.select("node").distinct(), "node", "left_anti").orderBy("file", "start").limit(1).collect()
        for r in first:
            rows.append(("q", f"read {r['file']}:{r['start']}-{r['stop']}", answer["outcome"], "signal", [signal], *common, 1, r["stop"] - r["start"] + 1, 1, len(answer["missing_signals"]), len(answer["ambiguities"])))
    for x in answer["ambiguities"]:
        n = len(x["options"].split(","))
        rows.append(("q", f"tell apart {x['options']}", answer["outcome"], "ambiguity", [], *common, n, 8 * n, n, len(answer["missing_signals"]), len(answer["ambiguities"])))
    if not rows:
        return []
    ranked = evidence.rank_escalations(evidence.escalations(a.spark.createDataFrame(rows, _OPTION)))
    kinds = evidence.followup_budget(evidence.followup_kind(ranked.withColumn("closes_gap", (F.col("n_gaps") > 0) & (F.size("gain") > 0))))
    shown = ["option", "request", "cost", "gain", "expected", "allowed", "blocked_by", "confidence", "kind", "line_budget", "slice_budget", "file_budget"]
    return [r.asDict() for r in kinds.orderBy("rank").select(*shown).collect()]


def followup_of(answer: dict) -> dict | None:
    """The next question within its budget, if an escalation is allowed."""
    best = next((x for x in answer["escalation"] if x["allowed"]), None)
    if best is None:
        return None
    rails = ["read nothing beyond the budget", "keep to the contract"] + (["do not choose between ambiguous candidates without new evidence"] if best["kind"] == "ambiguity_resolution" else [])
    return {"question": answer["question"], "request": best["option"], "kind": best["kind"], "lines": best["line_budget"], "slices": best["slice_budget"], "files": best["file_budget"], "guardrails": rails}


def packet_of(answer: dict) -> dict:
    """A bounded piece of work for a reader: task, mode, order, targets, claims, and the form of its result."""
    intents = set(answer["intents"])
    task = "debug" if "debug" in intents else "refactor" if "refactor" in intents else "explain" if "explain_flow" in intents else "review" if intents & {"auth", "validation", "architecture"} else "locate"
    mode = {"confirmed": "verify", "partial": "complete", "ambiguous": "disambiguate", "unproven": "explore"}[answer["outcome"]]
    c = answer["contract"]
    return {
        "task": task,
        "mode": mode,
        "read_order": c["required_read_order_refs"],
        "targets": [x["node"] for x in answer["candidates"][:3]],
        "claims": c["allowed_claims"],
        "done_when": c["valid_stop_conditions"],
        "result_template": {"inspected_slice_refs": [], "inspected_symbols": [], "used_claims": [], "final_claim": "", "final_outcome": "", "stop_condition": "", "completion_state": COMPLETION_STATES[0], "followup_used": False},
        "trace_template": [{"slice": r, "seen": [], "unclear": []} for r in c["required_read_order_refs"]],
    }


def prompt_of(answer: dict) -> str:
    c = answer["contract"]
    read = "\n".join(f"{k}. {r}" for k, r in enumerate(c["required_read_order_refs"], 1)) or "nothing"
    claims = "\n".join(f"- {x}" for x in c["allowed_claims"])
    more = f"\n# If that is not enough\n\n{answer['followup']['request']} (at most {answer['followup']['lines']} lines)\n" if answer["followup"] else ""
    return (
        f"# Question\n\n{answer['question']}\n\n# Read in this order\n\n{read}\n\n# Claims that the evidence allows\n\n{claims}\n\n"
        f"The outcome is at most `{c['expected_ceiling']}`. Signals without evidence: {', '.join(answer['missing_signals']) or 'none'}.\n{more}"
    )


def why(a: Analysis, symbol: str) -> list[dict]:
    return [r.asDict() for r in risk.why(symbol, a.metrics, a.edges.select("src", "dst")).orderBy("part", "rank").collect()]
