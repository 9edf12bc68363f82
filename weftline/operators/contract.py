"""Checking a worker's result against its contract, a row a result, with array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.constants import OUTCOME_ORDER, TERMINAL_STATES

_TEXTS = "array<string>"


def matched_prefix(required: Column, observed: Column) -> Column:
    """How many of the required items, from the first on, occur among the observed ones in this order."""
    fold = F.aggregate(observed, F.lit(0), lambda k, x: F.when(x == F.get(required, k), k + 1).otherwise(k))
    return F.when(F.size(required) == 0, 0).otherwise(fold)


def read_order(rows: DataFrame) -> DataFrame:
    """rows(required, observed: arrays) with matched, ratio, missing, diverged_at and sequence_status.

    diverged_at: the position of the first observed item that is not the next
    required one, counted from 1, or one after the last if items are missing.
    """
    required, observed = F.filter("required", lambda x: x != ""), F.filter("observed", lambda x: x != "")
    out = rows.withColumn("required", required).withColumn("observed", observed)
    n, seen = F.size("required"), F.size("observed")
    out = out.withColumn("matched", matched_prefix(F.col("required"), F.col("observed")))
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at"))

    def step(a: Column, x: Column) -> Column:
        hit = x == F.get(F.col("required"), a["k"])
        miss = F.coalesce(~hit, F.lit(False)) & a["at"].isNull() & (a["k"] < n)
        return F.struct(F.when(hit, a["k"] + 1).otherwise(a["k"]).alias("k"), (a["i"] + 1).alias("i"), F.when(miss, a["i"] + 1).otherwise(a["at"]).alias("at"))

    walked = F.aggregate("observed", start, step)
    short = F.col("matched") < n
    out = out.withColumn("diverged_at", F.when(short, F.coalesce(walked["at"], F.when(seen > 0, seen + 1))))
    status = (
        F.when(n == 0, "no_requirements")
        .when(F.col("matched") == n, "complete_in_order")
        .when(seen == 0, "not_started")
        .when(F.col("matched") == 0, "diverged_before_start")
        .otherwise("partial_with_divergence")
    )
    return (
        out.withColumn("ratio", F.when(n == 0, 1.0).otherwise(F.round(F.col("matched") / F.greatest(n, F.lit(1)), 2)))
        .withColumn("missing", F.when(short, F.slice("required", F.col("matched") + 1, n)).otherwise(F.array().cast(_TEXTS)))
        .withColumn("sequence_status", status)
    )


def primary_coverage(rows: DataFrame) -> DataFrame:
    """rows(required, observed: arrays) with matched and missing (arrays), ratio and status."""
    held = lambda x: F.array_contains("observed", x)
    out = rows.withColumn("matched", F.filter("required", held)).withColumn("missing", F.filter("required", lambda x: ~held(x)))
    n = F.size("required")
    status = F.when(n == 0, "no_requirements").when(F.size("matched") == 0, "not_started").when(F.size("missing") == 0, "complete").otherwise("partial")
    return out.withColumn("ratio", F.when(n == 0, 1.0).otherwise(F.round(F.size("matched") / F.greatest(n, F.lit(1)), 2))).withColumn("status", status)


def _rank(mode: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for k, v in OUTCOME_ORDER.items() for x in (k, v)))[mode], F.lit(-1))


def validate(rows: DataFrame) -> DataFrame:
    """rows with valid, violations and warnings (arrays of rule ids), accepted, rejected (claims) and capped_outcome.

    A row holds a contract: allowed_claims, disallowed_claims,
    required_read_order_refs, required_primary_symbols, valid_stop_conditions,
    supported_states, rules (arrays), expected_ceiling, minimum_honest,
    followup_allowed; and a result: inspected_slice_refs, inspected_symbols,
    used_claims (arrays), final_claim, final_outcome, stop_condition,
    completion_state, followup_used. A null is an empty array or text, or false.
    """
    arrays = ("allowed_claims", "disallowed_claims", "required_read_order_refs", "required_primary_symbols", "valid_stop_conditions", "supported_states", "rules", "inspected_slice_refs", "inspected_symbols", "used_claims")
    texts = ("expected_ceiling", "minimum_honest", "final_claim", "final_outcome", "stop_condition", "completion_state")
    out = rows.withColumns({c: F.coalesce(c, F.array().cast(_TEXTS)) for c in arrays} | {c: F.trim(F.coalesce(c, F.lit(""))) for c in texts})
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("followup_allowed", "followup_used")})
    claims = F.array_distinct(F.filter(F.array_append("used_claims", F.col("final_claim")), lambda c: c != ""))
    out = out.withColumn("claims", claims)
    c = F.col
    fine = lambda x: F.array_contains("allowed_claims", x) & ~F.array_contains("disallowed_claims", x)
    out = out.withColumn("accepted", F.filter("claims", fine)).withColumn("rejected", F.filter("claims", lambda x: ~fine(x)))
    terminal, waiting = c("completion_state").isin(*TERMINAL_STATES), c("completion_state").isin("ready_for_execution", "in_progress")
    said, ceiling, floor = _rank(c("final_outcome")), _rank(c("expected_ceiling")), _rank(F.when(c("minimum_honest") == "", c("expected_ceiling")).otherwise(c("minimum_honest")))
    has = c("final_outcome") != ""
    ordered, first = F.size("required_read_order_refs") > 0, F.get("inspected_slice_refs", F.lit(0))
    missing = F.size(F.array_except("required_primary_symbols", "inspected_symbols")) > 0
    unsupported = (c("completion_state") != "") & ~F.array_contains("supported_states", c("completion_state"))
    unproven_io = F.exists("claims", lambda x: F.lower(x).contains("direct network i/o") & ~F.array_contains("allowed_claims", x))
    violations = [
        ("must_respect_allowed_claims", F.size("rejected") > 0),
        ("must_not_use_disallowed_claims", F.size(F.array_intersect("claims", "disallowed_claims")) > 0),
        ("must_not_exceed_outcome_ceiling", has & (said > ceiling)),
        ("must_not_drop_below_minimum_honest_outcome", has & (said < floor)),
        ("must_set_final_outcome_for_terminal_result", ~has & terminal),
        ("must_read_primary_slice_first", ordered & F.when(first.isNotNull(), first != F.get("required_read_order_refs", F.lit(0))).otherwise(~waiting)),
        ("must_read_required_sequence_for_terminal_result", ordered & terminal & (matched_prefix(c("required_read_order_refs"), c("inspected_slice_refs")) < F.size("required_read_order_refs"))),
        ("must_cover_required_primary_symbols_for_terminal_result", missing & terminal),
        ("must_stop_when_completion_criteria_met", unsupported | (terminal & ~F.array_contains("valid_stop_conditions", c("stop_condition")))),
        ("must_not_open_followup_when_disabled", ~c("followup_allowed") & c("followup_used")),
        ("must_not_claim_uniqueness_while_ambiguous", F.array_contains("rules", "must_not_claim_uniqueness_while_ambiguous") & has & (c("final_outcome") != "ambiguous")),
        ("must_not_claim_direct_io_without_direct_evidence", F.array_contains("rules", "must_not_claim_direct_io_without_direct_evidence") & unproven_io),
    ]
    warnings = [
        ("must_not_exceed_outcome_ceiling", ~has & ~terminal & ~waiting),
        ("must_cover_required_primary_symbols_for_terminal_result", missing & ~terminal & (F.size("inspected_symbols") > 0)),
    ]
    pick = lambda rules: F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))
    out = out.withColumn("violations", pick(violations)).withColumn("warnings", pick(warnings))
    capped = F.when(has & (said <= ceiling), c("final_outcome")).otherwise(c("expected_ceiling"))
    return out.withColumn("valid", F.size("violations") == 0).withColumn("capped_outcome", capped)


def result_report(validated: DataFrame) -> DataFrame:
    """validated() rows with status, accepted_mode and next_action."""
    c = F.col
    waiting = c("completion_state").isin("", "ready_for_execution", "in_progress")
    status = F.when(~c("valid"), "rejected").when(waiting, "open").when(F.size("warnings") > 0, "accepted_with_warnings").otherwise("accepted")
    action = F.when(status == "rejected", "fix_violations").when(status == "open", "continue").when(c("followup_allowed") & (c("capped_outcome") != "confirmed"), "consider_followup").otherwise("close")
    return validated.withColumn("status", status).withColumn("accepted_mode", F.when(c("valid"), c("capped_outcome"))).withColumn("next_action", action)
