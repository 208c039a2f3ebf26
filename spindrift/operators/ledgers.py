"""Ledgers of candidates: memory, replay, usage, watch lists, and checkpoints of long runs."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.numeric import divide
from spindrift.functions.numeric import steady_round as rnd
from spindrift.operators.gates import shape_features, sorted_fields

# Limits of the smoke flags (survey A26).
LEAST_IC, LEAST_WINDOWS, LEAST_POSITIVE = 0.01, 4, 0.5
# Lengths of the lists of groups to watch and to demote (survey M31).
WATCHED, DEMOTED, LEAST_DEMOTED = 8, 12, 2
# Limits of the research pool, and parts of a round's score as (weight, full mark) (survey M34).
POOL_TURNOVER, POOL_IC, POOL_HORIZONS = 0.98, 0.025, 1
ROUND_PARTS = {"research_pool": (0.45, None), "non_future": (0.20, None), "lanes": (0.15, 18.0), "fieldsets": (0.12, 30.0), "shapes": (0.08, 24.0), "top10_abs_ic_mean": (0.08, 0.08)}
# Weights of integration states, field families and stated priorities (survey M42).
STATE_WEIGHTS = {"panel_only": 5.0, "factor_pack_only_missing_panel": 4.5, "contract_only": 3.0, "probe_or_backlog": 2.0, "integrated_selector_ready": 1.0, "integrated_selector_selected": 0.5}
FAMILY_WEIGHTS = {
    "limit_event_sentiment": 3.0,
    "flow_liquidity": 2.8,
    "capacity_size": 2.6,
    "leverage_flow": 2.4,
    "group_market_context": 2.3,
    "disclosure_event_flow": 2.1,
    "fundamental_quality_risk": 1.8,
    "holder_corporate_action": 1.6,
    "price_state": 1.2,
    "fundamental": 1.2,
}
PRIORITY_WEIGHTS = {"very_high": 3.0, "high": 2.0, "medium": 1.0, "low": 0.2}
# What a replay's long-only decision is worth (survey C19).
DECISION_WORTH = {"LONG_ONLY_REVIEW": 0.14, "WATCHLIST_LONG_ONLY": 0.08, "HOLD_WEAK_LONG_ONLY": 0.0, "REJECT_NO_LONG_ONLY_METRICS": -0.10, "REJECT_NON_POSITIVE_LONG_RETURN": -0.12}
UNKNOWN_DECISION_WORTH = -0.02
#: Dimensions of profiles that say which are compared.
CELL_DIMENSIONS = 3


def replay_objective(evaluations: DataFrame) -> DataFrame:
    """By each group an evaluation belongs to (lane, source, cell, field): how many, how many passed, mean correlation, and what follows.

    Of the groups of which none passed, the best few of a positive mean are watched; of those
    of two or more evaluations and no positive mean the first few, worst first, are demoted.
    """
    keys = F.concat(
        F.array(*[F.struct(F.lit(k).alias("group"), F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit("unknown")).alias("key")) for k in ("lane", "source", "cell")]),
        F.transform(F.filter(F.split("fields", r"\|"), lambda f: f != ""), lambda f: F.struct(F.lit("field").alias("group"), f.alias("key"))),
    )
    out = evaluations.select("passed", "mean_ic", F.inline(keys)).groupBy("group", "key").agg(
        F.count("*").alias("evaluations"), F.count_if("passed").alias("passed"), F.avg("mean_ic").alias("mean_ic")
    )
    out = out.withColumn("pass_rate", divide(F.col("passed"), F.col("evaluations")))
    idle = out.where("passed = 0")
    watched = idle.where("mean_ic > 0").orderBy(F.desc("mean_ic"), "group", "key").limit(WATCHED)
    demoted = idle.where((F.col("evaluations") >= LEAST_DEMOTED) & (F.coalesce("mean_ic", F.lit(0.0)) <= 0)).orderBy(F.asc_nulls_first("mean_ic"), F.desc("evaluations"), "group", "key").limit(DEMOTED)
    marked = watched.select("group", "key", F.lit("watched").alias("status")).unionAll(demoted.select("group", "key", F.lit("demoted")))
    return out.join(marked, ["group", "key"], "left").withColumn("status", F.coalesce("status", F.lit("neutral")))


def best_ic() -> Column:
    """The size of a decision's correlation: the absolute one, or where that is missing or nil the aligned one."""
    return F.abs(F.coalesce(F.nullif(F.col("abs_aligned_ic_mean"), F.lit(0.0)), "aligned_ic_mean", F.lit(0.0)))


def round_metrics(decisions: DataFrame) -> DataFrame:
    """One row of a round: how much is worth research, free of wrong lags, how diverse, how good its best, and the score of it all."""
    shaped = shape_features(decisions.withColumn("__fields_of", F.array_join(sorted_fields(F.coalesce("expression", F.lit(""))), "|")))
    future = F.contains(F.coalesce("blocker_flags", F.lit("")), F.lit("future_signal_wrong_lag_too_strong"))
    crowded = F.contains(F.coalesce("blocker_flags", F.lit("")), F.lit("signal_corr_abs"))
    pool = ~future & (F.coalesce("mean_one_way_turnover", F.lit(0.0)) <= POOL_TURNOVER) & (best_ic() >= POOL_IC) & (F.coalesce("positive_horizon_count", F.lit(0.0)).cast("int") >= POOL_HORIZONS)
    shape = F.when(F.col("expression") != "", F.concat_ws("|", "ast_depth_bin", "ast_operator_count_bin", "ast_field_count_bin", "ast_complexity_bin"))
    distinct = lambda c: F.count_distinct(F.nullif(c, F.lit("")))
    counted = shaped.agg(
        F.count("*").alias("candidates"),
        F.count_if(future | crowded).alias("hard_blocked"),
        F.count_if(~future).alias("non_future"),
        F.count_if(pool).alias("research_pool"),
        distinct(F.col("lane")).alias("lanes"),
        distinct(F.col("__fields_of")).alias("fieldsets"),
        distinct(shape).alias("shapes"),
        F.max(best_ic()).alias("best_abs_ic"),
    )
    top = decisions.select(best_ic().alias("__ic")).orderBy(F.desc("__ic")).limit(10).agg(F.coalesce(F.avg("__ic"), F.lit(0.0)).alias("top10_abs_ic_mean"))
    out = counted.crossJoin(F.broadcast(top))  # one row each
    size = F.greatest(F.col("candidates"), F.lit(1))
    part = lambda name, full: F.col(name) / size if full is None else F.least(F.lit(1.0), F.col(name) / F.lit(full))
    score = sum((part(name, full) * F.lit(weight) for name, (weight, full) in ROUND_PARTS.items()), F.lit(0.0))
    return out.withColumn("round_score", score)


def pack_preflight(pack: DataFrame, present: list[str]) -> DataFrame:
    """By field of a pack's formulas: lanes, number of formulas, and whether the panel has it."""
    x = pack.select("lane", "expression", F.explode("fields").alias("field"))
    out = x.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("lane")), "|").alias("lanes"), F.count_distinct("expression").alias("formulas"))
    return out.withColumn("present", F.col("field").isin(present))


def integration_priority(fields: DataFrame) -> DataFrame:
    """What state a field's integration is in, and how urgent its repair is.

    fields: rows with blocked_or_metadata, selector_selected, factor_pack_referenced and
    panel_materialized (missing: no), asset_status, source_registry, source_group,
    field_family and priority.
    """
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    probe = F.coalesce(F.col("asset_status").isin("blocked", "backlog"), F.lit(False))
    for c in ("source_registry", "source_group"):
        probe |= F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("probe"))
    packed, panel = f("factor_pack_referenced"), f("panel_materialized")
    state = (
        F.when(f("blocked_or_metadata"), "blocked_or_metadata")
        .when(f("selector_selected"), "integrated_selector_selected")
        .when(packed & panel, "integrated_selector_ready")
        .when(panel, "panel_only")
        .when(packed, "factor_pack_only_missing_panel")
        .when(probe, "probe_or_backlog")
        .otherwise("contract_only")
    )
    worth = lambda c, table: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(0.0))
    out = fields.withColumn("integration_status", state)
    score = (
        worth(F.col("integration_status"), STATE_WEIGHTS)
        + worth(F.col("field_family"), FAMILY_WEIGHTS)
        + worth(F.lower("priority"), PRIORITY_WEIGHTS)
        + F.when(panel != packed, 1.0).otherwise(0.0)
    )
    return out.withColumn("priority_score", score)


def integration_audit(assets: DataFrame, pack_refs: DataFrame, selector_refs: DataFrame, panel_fields: list[str]) -> DataFrame:
    """One row for each field that any source names: where it is found, its state and its priority.

    Each source is a table with a ``field``; assets also have an ``asset`` and what is
    stated of the field (asset_status, source_registry, source_group, field_family,
    priority, blocked_or_metadata); of several statements the first by value counts.
    """
    stated = ("asset_status", "source_registry", "source_group", "field_family", "priority")
    found = assets.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("asset")), "|").alias("assets"), F.bool_or("blocked_or_metadata").alias("blocked_or_metadata"), *[F.min(c).alias(c) for c in stated])
    packed = pack_refs.groupBy("field").agg(F.count("*").alias("pack_refs"), F.lit(True).alias("factor_pack_referenced"))
    chosen = selector_refs.groupBy("field").agg(F.count("*").alias("selector_refs"), F.lit(True).alias("selector_selected"))
    merged = found.join(packed, "field", "full").join(chosen, "field", "full")
    return integration_priority(merged.withColumn("panel_materialized", F.col("field").isin(panel_fields)))


def memory_stats(memory: DataFrame) -> DataFrame:
    """By production rule: records, share retained, mean reward."""
    return memory.groupBy("rule").agg(F.count("*").alias("records"), F.avg(F.col("retained").cast("double")).alias("retained_yield"), F.avg("reward").alias("mean_reward"))


def memory_of_role(memory: DataFrame, role: str) -> DataFrame:
    """Records of the same kind of data set; the others are quarantined, not lost."""
    return memory.withColumn("memory_state", F.when(F.col("dataset_role").eqNullSafe(F.lit(role)), "kept").otherwise("quarantined"))


def enrich_memory(memory: DataFrame, replays: DataFrame) -> DataFrame:
    """Memory with its replay: by candidate id if there is one, else by formula."""
    by_id = replays.select(F.col("candidate_id"), F.col("replay_reward").alias("__a")).dropDuplicates(["candidate_id"])
    by_key = replays.groupBy("expression_key").agg(F.max("replay_reward").alias("__b"))
    joined = memory.join(by_id, "candidate_id", "left").join(by_key, "expression_key", "left")
    return joined.select(*memory.columns, F.coalesce("__a", "__b").alias("replay_reward"), F.when(F.col("__a").isNotNull(), "candidate_id").when(F.col("__b").isNotNull(), "expression_key").alias("matched_by"))


def _within(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def replay_reward() -> Column:
    """A replay's worth to the searchers: its long-only decision, long return and Sortino, correlation, tradability, less its smoke flags.

    Reads auto_long_only_decision, mean_window_long_return, mean_window_long_sortino,
    mean_window_rank_ic, tradability_filter_available and smoke_flags (an array).
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    decision = F.coalesce(F.create_map(*[F.lit(x) for kv in DECISION_WORTH.items() for x in kv])[F.col("auto_long_only_decision")], F.lit(UNKNOWN_DECISION_WORTH))
    return (
        decision
        + _within(number("mean_window_long_return") * 40.0, -0.18, 0.18)
        + _within(number("mean_window_long_sortino") * 0.08, -0.16, 0.24)
        + _within(number("mean_window_rank_ic") * 4.0, -0.08, 0.08)
        + F.when(F.coalesce("tradability_filter_available", F.lit(False)), 0.02).otherwise(-0.03)
        - F.least(F.lit(0.12), F.coalesce(F.size("smoke_flags"), F.lit(0)) * 0.04)
    )


def candidate_reward() -> Column:
    """A candidate's worth before any replay: kept, new, fully evaluated, its measures and earlier feedback, less its complexity.

    Reads retained, novel_structure, full_evaluation_reached, ic_max, oos_stability,
    ic_positive_coverage, real_replay_feedback_score, char_count and operator_count.
    """
    flag = lambda c, yes, no: F.when(F.coalesce(F.col(c), F.lit(False)), yes).otherwise(no)
    return (
        flag("retained", 0.20, -0.10)
        + flag("novel_structure", 0.08, -0.03)
        + flag("full_evaluation_reached", 0.06, 0.0)
        + F.col("ic_max") * 0.32
        + F.col("oos_stability") * 0.20
        + F.col("ic_positive_coverage") * 0.14
        + F.least(F.lit(0.18), F.coalesce("real_replay_feedback_score", F.lit(0.0)))
        - F.least(F.lit(0.35), F.col("char_count") / 4000.0 + F.col("operator_count") / 800.0)
    )


def smoke_flags(windows: DataFrame, recent: int = 4, key: str = "candidate") -> DataFrame:
    """By candidate, over its windows: means, recent means, what speaks against it, and the first decision.

    Means leave out windows without a value; the share of positive windows is that of the recent ones.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("window")))
    w = windows.withColumn("__recent", F.when(place <= recent, F.col("mean_rank_ic")))
    out = w.groupBy(key).agg(
        F.count("*").alias("windows"),
        F.avg("mean_rank_ic").alias("mean_ic"),
        F.avg("__recent").alias("recent_ic"),
        F.avg((F.col("__recent") > 0).cast("double")).alias("recent_positive_ratio"),
    )
    against = [
        F.when(F.col("mean_ic").isNull(), "no_valid_quarterly_rank_ic").when(F.col("mean_ic") < LEAST_IC, "weak_mean_rank_ic_below_0_01"),
        F.when(F.col("recent_ic").isNull(), "no_recent_quarterly_rank_ic").when(F.col("recent_ic") <= 0, "non_positive_recent_mean_rank_ic"),
        F.when(F.col("recent_positive_ratio") < LEAST_POSITIVE, "recent_positive_quarter_ratio_below_0_5"),
        F.when(F.col("windows") < LEAST_WINDOWS, "insufficient_quarterly_windows"),
    ]
    decision = (
        F.when(F.col("mean_ic").isNull(), "reject_no_valid_recent_ic")
        .when(F.col("mean_ic") >= LEAST_IC, "needs_full_history_review")
        .when(F.col("mean_ic") > 0, "watchlist_weak_positive_recent_ic")
        .otherwise("reject_non_positive_recent_ic")
    )
    return out.withColumns({"flags": F.concat_ws("|", *against), "decision": decision})


def watch_groups(fields: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """Fields whose text holds the pattern of a watch group, given as (group, pattern)."""
    met = F.array_compact(F.array(*[F.when(F.contains("haystack", F.lit(p)), F.lit(g)) for g, p in groups]))
    return fields.select(F.explode(F.array_distinct(met)).alias("group"), "field").distinct()


def match_aliases(fields: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """Raw field names and the (asset, alias) they go by: equal, one of their words, or successive words of them."""
    words = lambda c: F.array_join(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""), "|")
    own = F.concat(F.lit("|"), words(F.col("field")), F.lit("|"))
    tests = []
    for asset, alias in aliases:
        inner = F.concat(F.lit("|"), words(F.lit(alias)), F.lit("|"))
        how = F.when(F.lower("field") == alias.lower(), "equal").when(F.contains(own, inner), F.when(F.lit("_" in alias), "sequence").otherwise("token"))
        tests.append(F.when(how.isNotNull(), F.struct(F.lit(asset).alias("asset"), F.lit(alias).alias("alias"), how.alias("how"))))
    return fields.select("field", F.inline(F.array_compact(F.array(*tests)))).distinct()


def enrich_pool(pool: DataFrame, additions: DataFrame, memory: DataFrame, caps: dict[str, int], otherwise: int) -> DataFrame:
    """The pool and those additions that neither it nor memory has, the best of each bucket up to its cap."""
    known = pool.select("expression_hash").unionByName(memory.select("expression_hash")).distinct()
    new = additions.join(known, "expression_hash", "left_anti")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("quality"), "expression_hash"))
    cap = F.lit(otherwise)
    for bucket, n in caps.items():
        cap = F.when(F.col("bucket") == bucket, n).otherwise(cap)
    kept = new.dropDuplicates(["expression_hash"]).withColumn("__place", place).where(F.col("__place") <= cap).drop("__place")
    return pool.unionByName(kept, allowMissingColumns=True)


# Most that a share may be, what the rest is dealt to, and the order in which buckets give way (survey A10).
BUDGET_CAPS = {"event": 0.60, "research": 0.35, "fundamental": 0.25}
REST_SHARES = {"r0_cem_led": 0.43, "ast_failure_aware_repair": 0.21, "agnostic_freeform_ast": 0.20, "formula_gen_v2_repair_expansion": 0.13}
RESIDUAL = "replay_aware_residual"
GIVE_WAY = (RESIDUAL, "formula_gen_v2_repair_expansion", "agnostic_freeform_ast", "ast_failure_aware_repair", "r0_cem_led", "research", "fundamental", "event")


def bucket_budgets(total: int, event: float, research: float, fundamental: float = 0.0) -> dict[str, int]:
    """Whole budgets that sum to ``total``: capped shares, each rounded, and the rest in fixed parts.

    Where the three shares are too much, research gives way first, then fundamental. What
    rounding leaves over is the residual bucket's; what it takes too much is given back in
    ``GIVE_WAY``'s order, and what is missing then goes to the first of the fixed parts.
    """
    total = max(1, int(total))
    out = {k: round(total * min(BUDGET_CAPS[k], max(0.0, float(v)))) for k, v in (("event", event), ("research", research), ("fundamental", fundamental))}
    for name in ("research", "fundamental"):
        out[name] -= min(out[name], max(0, sum(out.values()) - total))
    rest = max(0, total - sum(out.values()))
    dealt = {k: round(rest * v) for k, v in REST_SHARES.items()}
    out |= dealt | {RESIDUAL: max(0, rest - sum(dealt.values()))}
    for name in GIVE_WAY:
        out[name] -= min(out[name], max(0, sum(out.values()) - total))
    out["r0_cem_led"] += total - sum(out.values())
    return out


def lifecycle_audit(coverage: DataFrame, usage: DataFrame, required: list[str], least_fields: int, lanes: list[str]) -> dict:
    """Whether data and candidates fit together: blockers, and the decision they lead to.

    coverage: rows (field, nonnull); usage: rows (field, lane, uses, effective).
    """
    there = {r["field"]: r["nonnull"] for r in coverage.groupBy("field").agg(F.sum("nonnull").alias("nonnull")).collect()}
    used = {r["lane"]: r for r in usage.groupBy("lane").agg(F.sum("uses").alias("uses"), F.sum("effective").alias("effective")).collect()}
    against = []
    if len(there) < least_fields:
        against.append("too_few_fields")
    against += [f"missing_{k}" for k in required if not there.get(k)]
    for lane in lanes:
        row = used.get(lane)
        against += [f"{lane}_unused"] if row is None or not row["uses"] else [f"{lane}_without_effect"] if not row["effective"] else []
    return {"blockers": against, "decision": "READY" if not against else "HOLD"}


def evidence_gate(present: dict[str, bool], measured: dict[str, float], least: dict[str, float]) -> dict:
    """Whether required files are there and every measure reaches its least value."""
    missing = sorted(k for k, v in present.items() if not v)
    low = sorted(k for k, v in least.items() if measured.get(k, float("-inf")) < v)
    return {"ready": not missing and not low, "missing": missing, "below": low}


def feedback_allowed(clean: int, least: int, arm_override: bool | None, exploit_families: int, needs_exploit: bool) -> tuple[bool, str]:
    """Whether feedback may change a searcher's policy, and why not."""
    if arm_override is False:
        return False, "arm_table_forbids"
    if clean < least and not arm_override:
        return False, "too_few_clean_rows"
    if needs_exploit and exploit_families <= 0:
        return False, "no_exploit_family"
    return True, ""


def proxy_audit(candidates: DataFrame, cells: DataFrame, by: list[str], iterations: int = 2000) -> DataFrame:
    """Candidates by their sign-aligned spreads over shards and horizons: Sortino, resampled odds, and what to do.

    candidates: rows (by, aligned_ic_mean, mean_one_way_turnover, blocker_flags); cells: rows
    (by, cell, spread, ic). A candidate of negative aligned correlation is turned round. Of
    the reasons to hold a candidate back the first counts; a missing or nil turnover is one.
    """
    from spindrift.functions.numeric import sortino_of_shortfall
    from spindrift.operators.metrics import day_bootstrap

    sign = F.when(F.coalesce("aligned_ic_mean", F.lit(0.0)) >= 0, 1.0).otherwise(-1.0)
    aligned = cells.join(candidates.select(*by, sign.alias("__sign")), by).select(*by, "cell", (F.col("spread") * F.col("__sign")).alias("value"), (F.col("ic") * F.col("__sign")).alias("signed_ic"))
    own = aligned.groupBy(*by).agg(
        F.count("value").alias("proxy_obs"),
        F.avg("value").alias("proxy_mean_spread"),
        F.avg((F.col("value") > 0).cast("double")).alias("proxy_hit_rate"),
        sortino_of_shortfall(F.col("value")).alias("proxy_sortino"),
        F.avg("signed_ic").alias("proxy_mean_signed_ic"),
    )
    odds = day_bootstrap(aligned.select(*by, "cell", "value"), by, iterations, value="value").select(*by, F.col("prob_gt_0").alias("prob_sortino_gt_0"))
    out = candidates.join(own, by, "left").join(odds, by, "left")
    turnover = F.coalesce(F.nullif(F.col("mean_one_way_turnover"), F.lit(0.0)), F.lit(999.0))
    decision = (
        F.when(F.trim(F.coalesce("blocker_flags", F.lit(""))) != "", "HOLD_BLOCKED")
        .when(F.coalesce("prob_sortino_gt_0", F.lit(0.0)) < 0.80, "HOLD_WEAK_MCMC")
        .when(F.coalesce("proxy_sortino", F.lit(0.0)) <= 0, "HOLD_NEGATIVE_SORTINO")
        .when(turnover > 0.75, "HOLD_EXTREME_TURNOVER")
        .otherwise("REWARD_AUDIT_FOLLOWUP")
    )
    return out.withColumn("decision", decision)


def event_metadata(formulas: DataFrame, specs: DataFrame) -> DataFrame:
    """What is known of the event fields in each formula, joined in order of name."""
    x = formulas.select("expression", F.explode("fields").alias("field")).join(specs, "field")
    return x.groupBy("expression").agg(F.array_join(F.array_sort(F.collect_set("family")), "|").alias("families"), F.array_join(F.array_sort(F.collect_set("clock")), "|").alias("clocks"), F.count("*").alias("event_fields"))


def event_family(field: Column) -> Column:
    """The family that a parametric event field belongs to, by its name."""
    return (
        F.when(field.rlike("_streak_ge_|_streak"), "streak")
        .when(field.rlike("_count_t|_in_t"), "window_count")
        .when(field.rlike("high_board"), "market_high_board")
        .when(field.rlike("open"), "limit_open")
        .when(field.rlike("touch"), "limit_touch")
        .when(field.rlike("break|repair|rebound"), "limit_break")
        .when(field.rlike("flip"), "limit_flip")
        .when(field.rlike("limit"), "limit_close")
        .otherwise("unknown")
    )


def redundant_fields(profiles: DataFrame, least: float = 0.92) -> DataFrame:
    """Pairs of fields whose profiles point the same way: cosine at or above ``least``.

    Fields of equal profiles are one class, and only classes are compared. Unit vectors of
    that cosine are at most sqrt(2 - 2 * least) apart in each dimension, so classes meet by
    equal or neighbouring cells of that width in their first dimensions.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    width = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    norm = F.sqrt(dot(F.col("vector"), F.col("vector")))
    place = lambda k: F.floor(F.coalesce(F.get("vector", F.lit(k)), F.lit(0.0)) / F.col("norm") / width)
    classes = profiles.select("vector").distinct().withColumn("norm", norm).where("norm > 0").select("vector", F.array(*[place(k) for k in range(CELL_DIMENSIONS)]).alias("cell"))
    steps = [F.array(*map(F.lit, step)) for step in itertools.product((-1, 0, 1), repeat=CELL_DIMENSIONS)]
    a = classes.select(F.col("vector").alias("left_vector"), F.explode(F.array(*[F.zip_with("cell", step, lambda u, v: u + v) for step in steps])).alias("cell"))
    b = classes.select(F.col("vector").alias("right_vector"), "cell")
    size = F.sqrt(dot(F.col("left_vector"), F.col("left_vector")) * dot(F.col("right_vector"), F.col("right_vector")))
    near = a.join(b, "cell").withColumn("cosine", divide(dot(F.col("left_vector"), F.col("right_vector")), size)).where(F.col("cosine") >= least).drop("cell")
    left, right = (profiles.select(F.col("field").alias(f"{p}_field"), F.col("vector").alias(f"{p}_vector")) for p in ("left", "right"))
    pairs = near.join(left, "left_vector").join(right, "right_vector").where("left_field < right_field")
    return pairs.select("left_field", "right_field", rnd(F.col("cosine")).alias("cosine"))


def expression_profile(formulas: DataFrame, profiles: DataFrame) -> DataFrame:
    """The mean profile of a formula's fields."""
    x = formulas.select("expression", F.explode("fields").alias("field")).join(profiles, "field").select("expression", F.posexplode("vector").alias("dim", "v"))
    return x.groupBy("expression", "dim").agg(F.avg("v").alias("value"))


# Which words in a formula's fields or lane put it into which family (survey G13). Families of a kind are listed by name.
FIELD_FAMILIES = {
    "flow_amount_volume": "amount|volume|vol",
    "intraday_return": "intraday_ret_from_open|ret_1m",
    "lagged_context": "rzrq|billboard|holder",
    "limit_event_state": "limit|board|up_limit|lb_",
    "opening_state": "m1_first|opening|auction",
    "range_location": "range_location|range|high|low",
}
EVENT_FAMILIES = {"board_transition": "open_board|touch|board", "high_board": "lb_|high_board", "limit_up": "up_limit|limit_up", "opening_state": "auction|m1_first"}
PRIMITIVE_FAMILIES = {
    "cross_sectional": ("csrank", "rank", "zscore", "csresidual"),
    "time_series": ("delta", "delay", "mom", "mean", "std", "wma", "med"),
    "relation": ("corr", "cov"),
    "arithmetic": ("mul", "div", "add", "sub"),
    "state_transform": ("sign", "abs", "neg"),
}
ARM_WORDS = {"cem_exploit": "cem", "typed_ast_fresh": "ast|bt", "rx_ucb_fresh": "rx|ucb", "event_state": "event|limit|board", "random_orthogonal": "random|orthogonal", "challenger_repair": "mcts|repair"}
ROUTE_WORDS = {
    "phase3bs-adaptive-ucb-cem-practice": "phase3bs",
    "phase3bt-ast-algorithm-bakeoff": "phase3bt",
    "phase3bu-ast-fresh-winner-variants": "phase3bu",
    "phase3cm-train-portfolio-sortino-reward-audit": "phase3cm",
}
HORIZON_BUCKETS = ((5, "h1_5"), (15, "h5_15"), (30, "h15_30"))
TURNOVER_BUCKETS = ((0.35, "low_turnover"), (0.65, "medium_turnover"), (0.85, "high_turnover"))


def candidate_schema(candidates: DataFrame) -> DataFrame:
    """Candidates in the one schema of 36 text columns, whatever columns they come with.

    A value that is there stays; families, buckets and ids that aren't follow from the
    formula and the other columns. What is unknown is the empty text. Other columns stay behind.
    """
    def first(*names: str, default: Column | str = "") -> Column:
        there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in candidates.columns]
        return F.coalesce(*there, F.lit(default) if isinstance(default, str) else default)

    def by_word(text: Column, words: dict[str, str], default: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, pattern in words.items():
            out = out.when(text.rlike(pattern), name)
        return out.otherwise(default)

    def tags(text: Column, words: dict[str, str], default: str) -> Column:
        found = F.concat_ws("+", *[F.when(text.rlike(p), name) for name, p in words.items()])
        return F.when(found == "", default).otherwise(found)

    def number(*names: str) -> Column:
        value = first(*names).try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

    def bucket(value: Column, edges, beyond: str, unknown: Column, closed: bool) -> Column:
        out = F.when(value.isNull(), unknown)
        for edge, name in edges:
            out = out.when(value <= edge if closed else value < edge, name)
        return out.otherwise(beyond)

    short = lambda text, n: F.substring(F.sha2(text, 256), 1, n)
    expression = first("expression")
    lane = F.lower(first("factor_lane"))
    own = candidates.withColumns({"__text": expression, "__fields": F.array_join(sorted_fields(expression), "|"), "__names": F.transform(F.regexp_extract_all(expression, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)), F.lower)})
    names = F.col("__names")
    buckets = F.concat_ws("+", *[F.when(F.arrays_overlap(names, F.array(*map(F.lit, group))), family) for family, group in PRIMITIVE_FAMILIES.items()])
    primitive = F.when(F.size(names) == 0, "raw_field").when(buckets == "", F.array_join(F.array_sort(F.array_distinct(F.slice(names, 1, 4))), "+")).otherwise(buckets)
    described = F.lower(F.concat_ws(" ", *[first(c) for c in ("generator_arm", "source_generator", "source_lane", "factor_lane", "run", "round_id", "source_round")]))
    source = first("generator_route", "source_file", "run")
    multi = F.when(F.contains(F.lower("__text"), F.lit("1,5,15,30")), "multi_1_5_15_30").otherwise("multi_or_unknown")
    derived = {
        "__hash": first("expression_hash", default=short(F.col("__text"), 24)),
        "__field": first("field_family", default=tags(F.concat_ws("|", F.lower("__fields"), lane), FIELD_FAMILIES, "generic_price_volume")),
        "__primitive": first("primitive_family", default=primitive),
        "__event": first("event_state_family", default=tags(F.concat_ws("|", F.lower("__text"), F.lower(first("fields")), lane), EVENT_FAMILIES, "none")),
        "__horizon": first("horizon_bucket", default=bucket(number("horizon_min", "primary_horizon_min", "best_horizon_min"), HORIZON_BUCKETS, "h30_plus", multi, True)),
        "__turnover": first("turnover_bucket", default=bucket(number("train_mean_one_way_turnover", "mean_one_way_turnover"), TURNOVER_BUCKETS, "extreme_turnover", F.lit("turnover_unknown"), False)),
        "__subtree": short(F.concat_ws("|", F.array_join(F.slice(names, 1, 6), "|"), F.col("__fields")), 12),
        "__reward": first("optimizer_reward", "train_reward"),
    }
    own = own.withColumns(derived)
    c = F.col
    rewarded = lambda text: F.when(c("__reward") != "", text).otherwise("")
    out = {
        "candidate_id": first("candidate_id", default=F.substring(c("__hash"), 1, 12)),
        "expression_hash": c("__hash"),
        "expression": c("__text"),
        "generator_arm": first("generator_arm", default=by_word(described, ARM_WORDS, F.lit("unknown_arm"))),
        "generator_route": first("generator_route", default=by_word(F.lower(source), ROUTE_WORDS, source)),
        "round_id": first("round_id", "source_round"),
        "field_family": c("__field"),
        "primitive_family": c("__primitive"),
        "event_state_family": c("__event"),
        "horizon_bucket": c("__horizon"),
        "turnover_bucket": c("__turnover"),
        "family_id": first("family_id", default=short(F.concat_ws("|", "__field", "__primitive", "__event", "__horizon", "__turnover", "__subtree"), 18)),
        "motif_id": first("motif_id", default=short(F.concat_ws("|", "__field", "__primitive", "__event", "__subtree"), 18)),
        "subtree_hashes": first("subtree_hashes", default=c("__subtree")),
        "proxy_quality": first("proxy_quality", "phase3ca_proxy_quality", "proxy_sortino", "aligned_ic_mean"),
        "aligned_ic_mean": first("aligned_ic_mean", "abs_aligned_ic_mean"),
        "mean_one_way_turnover": first("mean_one_way_turnover", "train_mean_one_way_turnover"),
        "blocker_flags": first("blocker_flags", "phase3bp_blocker_flags", "inherited_blockers"),
        "optimizer_reward": c("__reward"),
        "optimizer_reward_source": first("optimizer_reward_source", default=rewarded("train_only_phase3cm")),
        "optimizer_reward_metric": first("optimizer_reward_metric", default=rewarded("train_portfolio_sortino_reward")),
        "optimizer_reward_split": first("optimizer_reward_split", default=rewarded("train")),
        "validation_usage": first("validation_usage", default="report_only"),
        "holdout_usage": first("holdout_usage", default="report_only"),
        "validation_mcmc_prob_gt_0": first("validation_mcmc_prob_gt_0", "validation_day_mcmc_prob_gt_0"),
        "holdout_mcmc_prob_gt_0": first("holdout_mcmc_prob_gt_0", "holdout_day_mcmc_prob_gt_0"),
    }
    plain = "seed parent_id mutation_type spread_hit_rate phase3ca_proxy_quality train_reward train_reward_decision train_reward_blockers validation_day_sortino holdout_day_sortino".split()
    return own.select(*[value.alias(name) for name, value in (out | {name: first(name) for name in plain}).items()])


# The files that hold reward tables (survey A16).
REWARD_FILES = ("phase3cm_train_reward.csv", "phase3cm_candidate_train_reward_summary.csv")


def find_reward_tables(spark: SparkSession, tables: list[str], roots: list[str]) -> list[str]:
    """Paths of reward tables: those named that are there, then what lies anywhere under the roots; each once, whatever its case."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    found = [t for t in tables if hadoop(t).getFileSystem(conf).exists(hadoop(t))]
    for root in roots:
        files = hadoop(root).getFileSystem(conf)
        if not files.exists(hadoop(root)):
            continue
        below = []
        walk = files.listFiles(hadoop(root), True)
        while walk.hasNext():
            path = walk.next().getPath()
            below.append((path.getName(), path.toUri().getPath()))
        found += [path for name in REWARD_FILES for own, path in sorted(below) if own == name]
    once: dict[str, str] = {}
    for path in found:
        once.setdefault(path.lower(), path)
    return list(once.values())


def read_reward_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The tables' candidates in the one schema; of a formula's rows the one of the first table, then the first by value."""
    out = None
    for number, path in enumerate(paths):
        rows = candidate_schema(read_ledger(spark, path)).where("expression != '' or expression_hash != ''").withColumn("__table", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return candidate_schema(spark.createDataFrame([], "expression string"))
    names = [c for c in out.columns if c != "__table"]
    first = F.min(F.struct("__table", *[c for c in names if c != "expression_hash"])).alias("first")
    return out.groupBy("expression_hash").agg(first).select(*[F.col("expression_hash") if c == "expression_hash" else F.col(f"first.{c}").alias(c) for c in names])


def merge_chunks(chunks: dict[int, DataFrame], value: str = "train_reward", decision: str = "train_reward_decision") -> tuple[DataFrame, dict]:
    """Rows of all chunks with ``parallel_chunk_id``, best first, and their counts anew; a column that a chunk lacks is null there."""
    out = None
    for number, rows in sorted(chunks.items()):
        own = rows.withColumn("parallel_chunk_id", F.lit(number))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    counts = out.agg(F.count("*").alias("candidate_count"), F.count_if(F.col(decision) == "TRAIN_REWARD_FOLLOWUP_READY").alias("followup_count")).first().asDict()
    ordered = out.orderBy(F.desc(F.coalesce(F.col(value).try_cast("double"), F.lit(-999.0))), "parallel_chunk_id")
    return ordered, counts | {"parallel_chunk_count": len(chunks)}


def append_checkpoint(batch: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Add a batch's rows to a checkpoint unless their keys are there; safe to repeat after a failure."""
    spark = batch.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
        batch = batch.join(done, keys, "left_anti")
    except Exception as first:
        if "PATH_NOT_FOUND" not in str(first):
            raise
    batch.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_report(rows: DataFrame, path: str, form: str = "csv") -> None:
    """A report as CSV (with a header), JSON or Parquet in zstd."""
    writer = rows.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form == "json":
        writer.json(path)
    else:
        writer.option("compression", "zstd").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger of records: CSV with a header, or JSON with line breaks."""
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.option("multiLine", True).json(path)
