"""What candidates earned, by family, arm and key; and what follows for the policy and the budget."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.numeric import divide
from spindrift.operators.gates import KNOWN, shape_features, sorted_fields

WRONG_LAG, CROWDED = "future_signal_wrong_lag_too_strong", "signal_corr_abs"
# Weights and limits of the scores.
CROWDING, STABLE_IC, WEAK_IC, FOLLOWUP_IC, EXTREME_TURNOVER = 0.75, 0.02, 0.03, 0.035, 0.95


def _has(column: str, token: str) -> Column:
    return F.contains(F.coalesce(F.col(column), F.lit("")), F.lit(token))


def _or0(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0.0))


def decide(aggregated: DataFrame, pairwise: DataFrame, crowding: float = CROWDING) -> DataFrame:
    """Of each formula its best horizon, what speaks against it, and whether to follow it up."""
    close = pairwise.where(F.abs("signal_rank_corr") >= crowding)
    crowded = close.select(F.col("left").alias("expression_hash")).union(close.select("right")).distinct().withColumn("crowded", F.lit(True))
    strength = F.abs(_or0("aligned_ic_mean"))
    best = F.max_by(F.struct("horizon", "aligned_ic_mean", "mean_one_way_turnover"), F.struct(strength, -F.col("horizon")))
    per = aggregated.groupBy("expression_hash").agg(
        best.alias("b"),
        F.count_if(strength > STABLE_IC).alias("positive_horizon_count"),
        F.count_if(_has("blocker_flags", WRONG_LAG)).alias("future_wrong_lag_horizon_count"),
    )
    out = per.join(crowded, "expression_hash", "left").select("expression_hash", "b.*", "positive_horizon_count", "future_wrong_lag_horizon_count", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    size = F.abs("aligned_ic_mean")
    against = [
        F.when(F.col("crowded"), f"signal_corr_abs_ge_{crowding}"),
        F.when(F.col("future_wrong_lag_horizon_count") > 0, WRONG_LAG),
        F.when(F.col("positive_horizon_count") < 2, "too_few_positive_horizons"),
        F.when(_or0("mean_one_way_turnover") > EXTREME_TURNOVER, "extreme_turnover"),
        F.when(size.isNull() | (size <= WEAK_IC), "weak_dense_primary_abs_ic"),
    ]
    out = out.withColumns({"abs_aligned_ic_mean": size, "blocker_flags": F.concat_ws("|", *against), "open_direction": F.when(F.col("aligned_ic_mean") >= 0, "long_top").otherwise("short_top")})
    return out.withColumn("decision", F.when((F.col("blocker_flags") == "") & (size > FOLLOWUP_IC), "bp_followup_priority").otherwise("bp_watch_or_reject"))


def summarize_by(decisions: DataFrame, key: str) -> DataFrame:
    return decisions.groupBy(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("unknown")).alias(key)).agg(
        F.count("*").alias("count"),
        F.max(F.abs(_or0("aligned_ic_mean"))).alias("best_abs_aligned_ic"),
        F.count_if(F.col("decision") == "bp_followup_priority").alias("followup_count"),
        F.count_if(_has("blocker_flags", WRONG_LAG)).alias("future_wrong_lag_count"),
    )


def round_quality() -> Column:
    """The score of a round's decision, within ±0.35."""
    ic, turnover = F.abs(_or0("abs_aligned_ic_mean")), _or0("mean_one_way_turnover")
    future, crowded = _has("blocker_flags", WRONG_LAG), _has("blocker_flags", CROWDED)
    score = 0.75 * F.least(ic, F.lit(0.25)) + 0.025 * F.least(_or0("positive_horizon_count"), F.lit(4.0))
    score = score + F.when(future, -0.22).otherwise(0.04) - F.when(crowded, 0.07).otherwise(0.0) - F.when(turnover > 0.95, 0.04).otherwise(0.0) - F.when(turnover < 0.25, 0.015).otherwise(0.0)
    return F.greatest(F.least(score, F.lit(0.35)), F.lit(-0.35))


def feedback_eligible() -> Column:
    usable = ~_has("blocker_flags", WRONG_LAG) & ~_has("blocker_flags", CROWDED)
    return usable & (_or0("mean_one_way_turnover") <= 0.98) & (F.abs(_or0("abs_aligned_ic_mean")) >= 0.025) & (_or0("positive_horizon_count") >= 1)


def audit_quality() -> Column:
    """The score by which candidates go to the reward audit."""
    score = (
        F.least(F.abs(_or0("aligned_ic_mean")), F.lit(0.30)) * 2.2
        + F.least(F.abs(_or0("aligned_spread_mean")), F.lit(0.002)) * 80.0
        + F.greatest(F.coalesce("spread_hit_rate", F.lit(0.5)) - 0.5, F.lit(0.0)) * 0.30
        + F.least(_or0("positive_horizon_count"), F.lit(4.0)) * 0.035
        - F.greatest(_or0("mean_one_way_turnover") - 0.55, F.lit(0.0)) * 0.45
    )
    return score - F.when(_has("blocker_flags", WRONG_LAG), 0.80).otherwise(0.0) - F.when(_has("blocker_flags", CROWDED), 0.18).otherwise(0.0)


def bridge_table(decisions: DataFrame, limit: int, allow_crowded: bool = False) -> DataFrame:
    """Decisions fit for the audit: no hard reject, scored, each formula once, the best first."""
    fit = ~_has("blocker_flags", WRONG_LAG) & (F.lit(allow_crowded) | ~_has("blocker_flags", CROWDED))
    scored = decisions.where(fit & F.col("expression_hash").isNotNull()).withColumn("proxy_quality", audit_quality())
    place = F.row_number().over(Window.partitionBy("expression_hash").orderBy(F.desc("proxy_quality"), "position"))
    return scored.withColumn("__place", place).where("__place = 1").drop("__place").orderBy(F.desc("proxy_quality"), "expression_hash").limit(limit)


def reward_marks(rewards: DataFrame, floor: float = 0.0, max_turnover: float = 0.75, validation_floor: float = 0.0) -> DataFrame:
    """Flags of each audited candidate. Validation is reported, never used for the optimiser."""
    reward = F.coalesce("optimizer_reward", "train_reward")
    words = F.lower(F.concat_ws("|", "blocker_flags", "train_reward_blockers", "inherited_blockers"))
    lagged = words.rlike("wrong_lag|high_corr|signal_corr_abs")
    turnover = F.coalesce("train_mean_one_way_turnover", F.lit(0.0))
    decision = F.coalesce("train_reward_decision", F.lit(""))
    clean = (reward > floor) & (turnover <= max_turnover) & (F.coalesce("train_reward_blockers", F.lit("")) == "") & (F.contains(decision, F.lit("FOLLOWUP_READY")) | (decision == "")) & ~lagged
    return rewards.withColumns(
        {
            "reward": reward,
            "clean": F.coalesce(clean, F.lit(False)),
            "survivor": F.coalesce(F.col("validation_day_sortino") >= validation_floor, F.lit(False)) | F.coalesce(F.col("validation_mcmc_prob_gt_0") >= 0.55, F.lit(False)),
            "hacked": F.coalesce((F.col("proxy_quality") > 0) & (F.col("train_reward") <= 0), F.lit(False)),
            "lagged": lagged,
            "busy": turnover > max_turnover,
        }
    )


def family_table(marked: DataFrame, floor: float = 0.0, max_share: float = 0.25) -> DataFrame:
    """By family: shares, median reward, counts, and a status of fixed precedence."""
    total = Window.partitionBy()
    out = marked.groupBy(F.coalesce("family_id", F.lit("unknown")).alias("family_id")).agg(
        F.count("*").alias("candidate_count"),
        F.percentile("reward", F.lit(0.5)).alias("median_train_reward"),
        F.count_if(F.col("reward") > floor).alias("positive_train_reward_count"),
        *[F.count_if(c).alias(f"{c}_count") for c in ("clean", "survivor", "hacked", "lagged", "busy")],
    )
    out = out.withColumn("family_share", divide(F.col("candidate_count"), F.sum("candidate_count").over(total)))
    crowd, hacked, lagged, busy = F.col("family_share") > max_share, F.col("hacked_count") > 0, F.col("lagged_count") > 0, F.col("busy_count") > 0
    base = F.when(lagged, "block").when(hacked | busy, "freeze").when(crowd, "downweight").otherwise("normal")
    open_now = base.isin("normal", "downweight") & (F.col("clean_count") > 0)
    reasons = F.concat_ws(
        "|",
        F.when(crowd, "top_family_share_cap"),
        F.when(hacked, "proxy_high_cm_negative"),
        F.when(lagged, "wrong_lag_or_high_corr"),
        F.when(busy & ~lagged, "high_turnover"),
        F.when(open_now, "train_optimizer_reward_positive"),
    )
    return out.withColumns({"family_status": F.when(open_now, "exploit_allowed").otherwise(base), "family_reasons": reasons})


def arm_scores(marked: DataFrame, families: DataFrame, floor: float = 0.0, max_turnover: float = 0.75, least_clean: int = 32) -> DataFrame:
    """By arm: rates, the composite score, and whether feedback may change the policy."""
    marked = marked.withColumn("family_id", F.coalesce("family_id", F.lit("unknown")))
    status = families.select("family_id", (F.col("family_status") == "exploit_allowed").alias("open"))
    by_family = marked.groupBy("generator_arm", "family_id").agg(F.count("*").alias("n")).join(status, "family_id", "left")
    spread = by_family.groupBy("generator_arm").agg(F.count("*").alias("families"), F.max("n").alias("top"), F.count_if("open").alias("exploit_allowed_family_count"))
    own = marked.groupBy("generator_arm").agg(
        F.count("*").alias("candidate_count"),
        F.count_if("clean").alias("clean_feedback_count"),
        F.coalesce(F.percentile("reward", F.lit(0.5)), F.lit(0.0)).alias("median_train_reward"),
        *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in (("positive_rate", F.col("reward") > floor), ("hack_rate", F.col("hacked")), ("lag_rate", F.col("lagged")), ("calm_rate", F.coalesce("train_mean_one_way_turnover", F.lit(1.0)) <= max_turnover), ("validation_rate", F.col("survivor")))],
    )
    out = own.join(spread, "generator_arm").withColumns({"new_family_rate": F.col("families") / F.col("candidate_count"), "top_family_concentration": F.col("top") / F.col("candidate_count")})
    score = F.col("positive_rate") + F.col("median_train_reward") + F.col("new_family_rate") + F.col("calm_rate") - F.col("hack_rate") - F.col("lag_rate") - F.col("top_family_concentration")
    return out.drop("families", "top").withColumns({"arm_score": score, "feedback_update_allowed": F.col("clean_feedback_count") >= least_clean})


# --- policy: rows (kind, key, score)

SHAPE_KINDS = "ast_skeleton ast_operator_sequence ast_operator_multiset ast_root_operator ast_depth_bin ast_operator_count_bin ast_field_count_bin ast_window_count_bin ast_max_window_bin ast_complexity_bin".split()


def policy_keys(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each thing about a formula that the policy scores: (kind, key)."""
    text = F.col("expression")
    shaped = shape_features(rows)
    operators = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda c: c.isin(KNOWN)))
    windows = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r",\s*(\d+)\s*\)"), F.lit(1)), lambda w: w.try_cast("int").between(1, 252)))
    fields = sorted_fields(text)
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    many = lambda kind, keys: F.transform(keys, lambda k: pair(kind, k))
    single = F.array(pair("lane", F.coalesce("lane", F.lit("unknown"))), pair("fieldset", F.array_join(fields, "|")), *[pair(k, F.col(k)) for k in SHAPE_KINDS])
    return shaped.select(*keep, F.inline(F.concat(single, many("field", fields), many("operator", operators), many("window", windows))))


def prior_reward() -> Column:
    """What an earlier result counts for, within ±0.25."""
    decision, flags = F.coalesce("decision", F.lit("")), F.coalesce("blocker_flags", F.lit(""))
    bonus = lambda text, token, value: F.when(F.contains(text, F.lit(token)), value).otherwise(0.0)
    value = F.abs(_or0("aligned_ic_mean")) + bonus(decision, "followup_priority", 0.035) + bonus(decision, "pass", 0.015)
    value = value - bonus(flags, WRONG_LAG, 0.18) - bonus(flags, CROWDED, 0.06) - bonus(flags, "weak_dense", 0.04) - bonus(flags, "too_few_positive_horizons", 0.03)
    return F.greatest(F.least(value, F.lit(0.25)), F.lit(-0.25))


def ucb_policy(priors: DataFrame, exploration: float = 0.45) -> DataFrame:
    """Upper confidence bounds by key: the mean reward and what so few observations leave open."""
    rewarded = priors.where("expression is not null and expression != ''").withColumn("reward", prior_reward())
    total = rewarded.count()
    open_part = math.log(max(2, total + 1))
    return policy_keys(rewarded, ["reward"]).groupBy("kind", "key").agg((F.avg("reward") + exploration * F.sqrt(F.lit(open_part) / F.count("*"))).alias("score"))


POLICY_WEIGHTS = {"lane": 0.18, "field": 0.21, "operator": 0.12, "window": 0.08, "fieldset": 0.15, "shape": 0.20}
FIELD_NOVELTY, SHAPE_NOVELTY = 0.01, 0.006


def policy_score(candidates: DataFrame, policy: DataFrame) -> DataFrame:
    """Each candidate's score: weighted means of its keys' scores, and a bonus for unseen ones."""
    keyed = policy_keys(candidates, ["expression_hash"]).join(policy, ["kind", "key"], "left")
    group = F.when(F.col("kind").isin(SHAPE_KINDS), "shape").otherwise(F.col("kind"))
    means = keyed.withColumn("group", group).groupBy("expression_hash", "group").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"), F.count_if(F.col("score").isNull()).alias("unseen"))
    weight = F.create_map(*[F.lit(x) for kv in POLICY_WEIGHTS.items() for x in kv])[F.col("group")]
    novelty = F.when(F.col("group") == "field", FIELD_NOVELTY * F.col("unseen")).when(F.col("group") == "shape", SHAPE_NOVELTY * F.col("unseen")).otherwise(0.0)
    return means.groupBy("expression_hash").agg(F.sum(weight * F.col("mean") + novelty).alias("policy_score"))


def policy_feedback(policy: DataFrame, decisions: DataFrame, rate: float = 0.55, floor: float = 0.015, least: int = 32, credit: Column | None = None, eligible: Column | None = None) -> DataFrame:
    """The policy moved towards what eligible decisions earned; unchanged if they are too few."""
    usable = decisions.where(feedback_eligible() if eligible is None else eligible).withColumn("credit", round_quality() if credit is None else credit)
    if usable.limit(max(1, least)).count() < max(1, least):
        return policy
    earned = policy_keys(usable, ["credit"]).groupBy("kind", "key").agg(F.avg("credit").alias("credit"))
    moved = (1 - rate) * F.coalesce("score", F.lit(floor)) + rate * F.col("credit")
    score = F.when(F.col("credit").isNull(), F.col("score")).otherwise(F.greatest(F.least(moved, F.lit(1.25)), F.lit(floor)))
    return policy.join(earned, ["kind", "key"], "full").select("kind", "key", score.alias("score"))


def policy_reward_feedback(policy: DataFrame, rewards: DataFrame, rate: float = 0.55, floor: float = 0.015, least: int = 32) -> DataFrame:
    """As :func:`policy_feedback`, by clean training rewards alone; validation and holdout are never read."""
    return policy_feedback(policy, rewards, rate, floor, least, credit=F.greatest(F.least(F.col("reward"), F.lit(0.35)), F.lit(-0.35)), eligible=F.col("clean"))


def boost(policy: DataFrame, by: float, floor: float) -> DataFrame:
    return policy.select("kind", "key", F.greatest(F.col("score") * by + floor, F.lit(floor)).alias("score"))


def blend(policies: list[tuple[DataFrame, float]]) -> DataFrame:
    """The weighted mean of policies over all their keys; a key that one lacks counts 0 there."""
    total = sum(w for _, w in policies) or 1.0
    parts = None
    for p, w in policies:
        part = p.select("kind", "key", (F.col("score") * (w / total)).alias("score"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("kind", "key").agg(F.sum("score").alias("score"))


# --- budget


@dataclass(frozen=True)
class Arm:
    """A generator and the share of the budget it may have."""

    name: str
    base: float
    least: float
    most: float
    category: str


#: Fixed: the arms and their shares.
ARMS = (
    Arm("rx_ucb_fresh", 0.26, 0.20, 0.42, "fresh"),
    Arm("typed_ast_fresh", 0.22, 0.18, 0.36, "fresh"),
    Arm("challenger_repair", 0.16, 0.08, 0.24, "fresh"),
    Arm("event_state", 0.14, 0.06, 0.22, "event"),
    Arm("cem_exploit", 0.14, 0.00, 0.22, "exploit"),
    Arm("random_orthogonal", 0.08, 0.04, 0.14, "control"),
)


def arm_health(row: dict | None) -> float:
    """How an arm's feedback moves its share, within ±0.30; nothing known moves nothing."""
    if not row:
        return 0.0
    value = lambda key: float(row.get(key) or 0.0)
    score = min(0.20, max(-0.20, value("median_train_reward"))) * 0.45 + min(8.0, value("clean_feedback_count")) * 0.01 + min(3.0, value("exploit_allowed_family_count")) * 0.025
    score -= value("hack_rate") * 0.24 + value("lag_rate") * 0.35 + max(0.0, value("top_family_concentration") - 0.25) * 0.35
    return max(-0.30, min(0.30, score + (0.06 if row.get("feedback_update_allowed") else -0.14)))


def fit_shares(target: dict[str, float], least: dict[str, float], most: dict[str, float], rounds: int = 8) -> dict[str, float]:
    """Shares moved to a sum of 1, each in proportion to the room it has."""
    shares = dict(target)
    for _ in range(rounds):
        off = sum(shares.values()) - 1.0
        if abs(off) <= 1e-9:
            break
        room = {k: max(0.0, v - least[k]) if off > 0 else max(0.0, most[k] - v) for k, v in shares.items()}
        total = sum(room.values())
        if total <= 0:
            break
        shares = {k: min(most[k], max(least[k], v - off * room[k] / total)) for k, v in shares.items()}
    return shares


def whole_budgets(shares: dict[str, float], total: int) -> dict[str, int]:
    """Whole numbers that sum to the total: rounded down, the largest remainders get one more."""
    exact = {k: v * total for k, v in shares.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: exact[k] - out[k], reverse=True)[: max(0, total - sum(out.values()))]:
        out[k] += 1
    return out


def schedule_arms(feedback: dict[str, dict], exploit_families: int, total: int, fresh_floor: float = 0.45, probe_cap: float = 0.06) -> list[dict]:
    """The budget of each arm: health moves shares, fresh arms keep a floor, exploitation is capped until feedback is clean."""
    health = {a.name: arm_health(feedback.get(a.name)) for a in ARMS}
    least, most, target, action = {}, {}, {}, {}
    for a in ARMS:
        row = feedback.get(a.name)
        least[a.name], most[a.name], goal, action[a.name] = a.least, a.most, a.base + health[a.name], "schedule"
        if a.category == "exploit":
            if not (row and row.get("feedback_update_allowed")) or exploit_families <= 0:
                least[a.name], most[a.name], action[a.name] = 0.0, min(a.most, max(0.0, probe_cap)), "probe_only"
            else:
                action[a.name] = "guarded_exploit"
        elif row is None and a.category in ("fresh", "event"):
            action[a.name] = f"{a.category}_floor"
        target[a.name] = min(most[a.name], max(least[a.name], goal))
    shares = fit_shares(target, least, most)
    fresh = [a.name for a in ARMS if a.category == "fresh"]
    other = [a.name for a in ARMS if a.category != "fresh"]
    gap = fresh_floor - sum(shares[n] for n in fresh)
    up = {n: max(0.0, most[n] - shares[n]) for n in fresh}
    down = {n: max(0.0, shares[n] - least[n]) for n in other}
    shift = min(gap, sum(up.values()), sum(down.values()))
    if shift > 0:
        shares |= {n: shares[n] + shift * up[n] / sum(up.values()) for n in fresh}
        shares |= {n: shares[n] - shift * down[n] / sum(down.values()) for n in other}
    budgets = whole_budgets(fit_shares(shares, least, most), max(1, total))
    return [{"arm_id": a.name, "category": a.category, "health_score": round(health[a.name], 8), "scheduler_action": action[a.name], "candidate_budget": budgets[a.name]} for a in ARMS]


def scale_budgets(shares: dict[str, float], total: int) -> dict[str, int]:
    """Rounded-down budgets, one at least where a share is positive, then moved one by one to the total."""
    out = {k: max(1, math.floor(v * total)) if v > 0 else 0 for k, v in shares.items()}
    order = sorted(shares, key=lambda k: -shares[k])
    at = 0
    while out and sum(out.values()) != total and any(out.values()):
        k = order[at % len(order)]
        step = 1 if sum(out.values()) < total else -1
        if shares[k] > 0 and (step > 0 or out[k] > 1 or sum(v > 1 for v in out.values()) == 0):
            out[k] += step
        at += 1
    return out


def family_actions(families: DataFrame, total: int, max_share: float = 0.25) -> DataFrame:
    """What the scheduler does with each family, and how many candidates it may have."""
    cap = max(0, math.floor(max(0.0, min(1.0, max_share)) * max(1, total)))
    status = F.lower(F.coalesce("family_status", F.lit("")))
    action = F.when(status == "block", "block").when(status == "freeze", "freeze").when(status == "exploit_allowed", "allow_followup").when(status == "downweight", "downweight").otherwise("observe")
    budget = F.when(status.isin("block", "freeze"), 0).when(status == "exploit_allowed", cap).otherwise(max(1, cap // 2))
    return families.select("family_id", action.alias("scheduler_action"), budget.alias("candidate_budget_cap"))
