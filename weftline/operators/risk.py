"""Risk scores and what explains them, module summaries, report comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.constants import CRITICAL, RISK_WEIGHT


def with_maxima(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """nodes with max_<column> of each column, 1 where that is 0 or there is no row."""
    best = nodes.agg(*(F.max(c).alias(f"max_{c}") for c in columns))
    best = best.select(*(F.when(F.coalesce(F.col(f"max_{c}"), F.lit(0)) == 0, 1).otherwise(F.col(f"max_{c}")).alias(f"max_{c}") for c in columns))
    return nodes.crossJoin(F.broadcast(best))  # one row


_SCALED = ["ca", "ce_internal", "ce_external", "pagerank", "betweenness", "git_hotness"]


def risk_scores(nodes: DataFrame) -> DataFrame:
    """nodes with risk: the weighted sum of scaled metrics, from 0 to 100, 2 places.

    nodes has instability, ca, ce_internal, ce_external, pagerank, betweenness,
    git_hotness, scc_size, self_call (boolean) and layer.
    """
    out = with_maxima(nodes, _SCALED)
    share = lambda c: F.col(c) / F.col(f"max_{c}")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    w = RISK_WEIGHT
    total = (
        w["instability"] * F.col("instability")
        + w["ca"] * share("ca")
        + w["betweenness"] * share("betweenness")
        + w["ce_internal"] * share("ce_internal")
        + w["pagerank"] * share("pagerank")
        + w["git"] * share("git_hotness")
        + w["cycle"] * flag(F.col("scc_size") > 1)
        + w["self_call"] * flag(F.col("self_call") & (F.col("ca") >= 2))
        + w["entry"] * flag((F.col("layer") <= 1) & (F.col("ce_internal") >= 2))
        + w["ce_external"] * share("ce_external")
    )
    return out.withColumn("risk", F.round(total * 100, 2)).drop(*(f"max_{c}" for c in _SCALED))


def reasons(nodes: DataFrame, git: bool = False) -> DataFrame:
    """nodes with reasons: an array of codes, in fixed order.

    Besides what risk_scores needs, nodes has risk, n_bases and signals (array).
    """
    out = with_maxima(nodes, ["ca", "ce_internal", "betweenness"])
    c = F.col
    sixty = lambda m: F.greatest(F.lit(3), F.ceil(c(m) * 0.6))
    rules: list[tuple[str, Column]] = [
        ("unstable", (c("instability") >= 0.8) & (c("ce_internal") >= 2)),
        ("many_dependents", c("ca") >= sixty("max_ca")),
        ("many_dependencies", c("ce_internal") >= sixty("max_ce_internal")),
        ("in_cycle", c("scc_size") > 1),
        ("bridge", c("betweenness") >= F.greatest(F.lit(0.05), c("max_betweenness") * 0.6)),
        ("self_recursive", c("self_call") & (c("ca") >= 2)),
        ("upper_layer_fan_out", (c("layer") <= 1) & (c("ce_internal") >= 2)),
        ("inherits", c("n_bases") > 0),
        ("external_surface", (c("ce_external") >= 5) & (c("ce_internal") >= 1)),
    ]
    if git:
        rules.append(("hotspot", (c("git_hotness") >= 0.7) & ((c("ca") >= 1) | (c("ce_internal") >= 2))))
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))
    found = F.when((F.size(found) == 0) & (c("risk") >= 55), F.array(F.lit("combined_pressure"))).otherwise(found)
    critical = F.size(F.array_intersect("signals", F.array(*map(F.lit, CRITICAL)))) > 0
    pressed = critical & ((c("instability") >= 0.7) | (c("ca") >= 3) | (c("ce_internal") >= 3))
    found = F.when(pressed, F.array_append(found, F.lit("signals_under_pressure"))).otherwise(found)
    return out.withColumn("reasons", found).drop("max_ca", "max_ce_internal", "max_betweenness")


def top_risks(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """The riskiest nodes, with single_point: three dependents or more and a risk of 60 or more."""
    out = nodes.withColumn("single_point", (F.col("ca") >= 3) & (F.col("risk") >= 60))
    return out.orderBy(F.desc("risk"), F.desc("ca"), F.desc("ce_total"), "node").limit(limit)


def module_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, n_nodes, ca, ce, instability, risk) from nodes(node, module) and edges between modules.

    ca and ce count distinct other modules; risk is 0.6 instability and 0.4 ca
    over the greatest ca, from 0 to 100.
    """
    of = nodes.select("node", "module").distinct()
    a, b = of.select(F.col("node").alias("src"), F.col("module").alias("ma")), of.select(F.col("node").alias("dst"), F.col("module").alias("mb"))
    pairs = edges.select("src", "dst").join(a, "src").join(b, "dst").where("ma <> mb").select("ma", "mb").distinct()
    out = of.groupBy("module").agg(F.count("*").alias("n_nodes"))
    out = out.join(pairs.groupBy(F.col("mb").alias("module")).agg(F.count("*").alias("ca")), "module", "left")
    out = out.join(pairs.groupBy(F.col("ma").alias("module")).agg(F.count("*").alias("ce")), "module", "left").na.fill(0, ["ca", "ce"])
    both = F.col("ca") + F.col("ce")
    out = out.withColumn("instability", F.when(both == 0, 0.0).otherwise(F.round(F.col("ce") / F.greatest(both, F.lit(1)), 4)))
    out = with_maxima(out, ["ca"])
    risk = F.round((0.6 * F.col("instability") + 0.4 * F.col("ca") / F.col("max_ca")) * 100, 2)
    return out.withColumn("risk", risk).drop("max_ca")


def hotness(numstat: DataFrame, places: int = 8) -> DataFrame:
    """(path, commits, churn, hotness) of numstat(path, added, deleted): commits are rows, churn added and deleted lines.

    Rows whose numbers are `-` (binary) do not count. hotness: 0.7 ln(1 + churn)
    + 0.3 ln(1 + commits), over the greatest.
    """
    rows = numstat.where("added <> '-' and deleted <> '-'")
    out = rows.groupBy("path").agg(F.count("*").alias("commits"), F.sum(F.col("added").cast("long") + F.col("deleted").cast("long")).alias("churn"))
    out = out.withColumn("raw", 0.7 * F.log1p("churn") + 0.3 * F.log1p("commits"))
    out = with_maxima(out, ["raw"])
    return out.select("path", "commits", "churn", F.round(F.col("raw") / F.col("max_raw"), places).alias("hotness"))


def jitter(text: Column, salt: str) -> Column:
    """A stable offset in [-1.5, 1.5] from the SHA-1 of salt:text."""
    digits = F.substring(F.sha1(F.concat(F.lit(f"{salt}:"), text).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") / 0xFFFFFFFF - 0.5) * 3


def layout(nodes: DataFrame) -> DataFrame:
    """(node, x, y, z): modules, by name, on a square grid of step 20, nodes jittered around them; z is minus the layer."""
    modules = nodes.select("module").distinct()
    # Numbering modules is one task over their names; there are far fewer than nodes.
    modules = modules.withColumn("k", F.row_number().over(Window.orderBy("module")) - 1)
    side = modules.agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*")))).alias("side"))
    out = nodes.join(modules, "module").crossJoin(F.broadcast(side))
    x = F.round((F.col("k") % F.col("side")) * 20 + jitter(F.col("node"), "x"), 3)
    y = F.round(F.floor(F.col("k") / F.col("side")) * 20 + jitter(F.col("node"), "y"), 3)
    return out.select("node", x.alias("x"), y.alias("y"), (-F.col("layer")).cast("double").alias("z"))


def report_diff(old: DataFrame, new: DataFrame, step: float = 1.0) -> DataFrame:
    """(symbol, status, old_risk, new_risk, change) of two reports(symbol, risk): appeared, resolved, improved, degraded, unchanged."""
    a, b = old.select("symbol", F.col("risk").alias("old_risk")), new.select("symbol", F.col("risk").alias("new_risk"))
    out = a.join(b, "symbol", "full_outer").withColumn("change", F.round(F.col("new_risk") - F.col("old_risk"), 2))
    status = (
        F.when(F.col("old_risk").isNull(), "appeared")
        .when(F.col("new_risk").isNull(), "resolved")
        .when(F.col("change") <= -step, "improved")
        .when(F.col("change") >= step, "degraded")
        .otherwise("unchanged")
    )
    return out.withColumn("status", status).select("symbol", "status", "old_risk", "new_risk", "change")


def why(symbol: str, nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """(part, rank, value): one symbol's metrics and its first callers and callees, by name."""
    own = nodes.where(F.col("node") == symbol)
    metrics = ["risk", "ca", "ce_internal", "instability", "layer", "scc_size"]
    rows = own.select(F.explode(F.array(*(F.struct(F.lit(m).alias("part"), F.lit(1).alias("rank"), F.col(m).cast("string").alias("value")) for m in metrics))).alias("r")).select("r.*")
    for part, near, far in (("caller", "dst", "src"), ("callee", "src", "dst")):
        ends = edges.where(F.col(near) == symbol).select(F.col(far).alias("value")).distinct()
        ends = ends.withColumn("rank", F.row_number().over(Window.orderBy("value"))).where(F.col("rank") <= limit)  # one symbol's edges
        rows = rows.unionByName(ends.select(F.lit(part).alias("part"), "rank", "value"))
    return rows
