"""Gates, decisions, feedback and policy tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.catalog import Catalog
from spindrift.functions.numeric import steady_round as rnd
from spindrift.operators import feedback as fb
from spindrift.operators import gates as g
from spindrift.operators.metrics import audit_split
from spindrift.sources.panels import daily_panel, table

TEXTS = [
    "CSRank(Sub(ZScore(Delta($volume,15)),Mean($close,20)))",
    "CSRank(EventCount($limit_up_touch_event,5))",
    "Corr($limit_up_streak,$close,20)",
    "Mean($high_board_rank,5)",
    "CSRank($ctx_zls_lbgd)",
    "ZScore($ctx_zls_lbgd)",
    "MaskedZScore($ctx_zls_lbgd,6,0.8)",
    "CSResidual($pe_ttm,$close)",
    "Rank($industry_code)",
    "Delay($next_open,1)",
    "CSRank($trade_time)",
    "future_return(5)",
    "1.5",
    "Sign(Sub($m1_first5_vwap,$open))",
    "Mul(CSRank(StateDwell($is_limit_up,5)),Div($amount,$volume))",
    "Wma($evt_uplimit_amount,3)",
    "Add(Std($ret,10),Corr($close,$volume,20))",
    "Log($fund_debt_to_assets)",
    "ValidRatioGate($turnover_ratio,6,0.8)",
    "SafeCSResidual($turnover_ratio,$amount,2,2,0.5)",
    "Cov(Mean($close,5),Std($close,10),15)",
    "Neg(Mom($close,60))",
    "CSRank(EventAge($auction_seal_amount))",
    "Skew($billboard_net,20)",
    "Abs(Delta($streak_count,2))",
]
VALUES = ", ".join(f"({k}, '{t}')" for k, t in enumerate(TEXTS))
FORMULAS = f"fm(k, expression) as (values {VALUES})"
FIELDS = r"'\$([A-Za-z_][A-Za-z0-9_]*)'"


def formulas(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, expression string")


def case_sql(name: str, rules: list, default: str) -> str:
    test = {
        "is": lambda words: f"{name} in ({', '.join(repr(w) for w in words)})",
        "has": lambda words: "(" + " or ".join(f"contains({name}, '{w}')" for w in words) + ")",
        "ends": lambda words: "(" + " or ".join(f"ends_with({name}, '{w}')" for w in words) + ")",
        "starts": lambda words: "(" + " or ".join(f"starts_with({name}, '{w}')" for w in words) + ")",
    }
    return "case " + " ".join(f"when {' or '.join(test[how](words.split()) for how, words in tests)} then '{label}'" for label, tests in rules) + f" else '{default}' end"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"



GATE_SQL = f"""
g0 as (select k, expression, f.f, f.i from fm left join (select k as fk, lower(unnest(regexp_extract_all(expression, {FIELDS}, 1))) as f, generate_subscripts(regexp_extract_all(expression, {FIELDS}, 1), 1) as i from fm) f on k = fk),
g1 as (select k, f, min(i) as i, {case_sql("f", g.CATEGORIES, g.DEFAULT_CATEGORY)} as cat from g0 where f is not null group by k, f),
g2 as (select k, string_agg(f, '|' order by i) filter (cat in ('timestamp_or_key', 'text_or_label')) as lab, string_agg(f, '|' order by i) filter (cat = 'membership_or_group_key') as mem,
  string_agg(f, '|' order by i) filter (cat in ('sparse_event', 'discrete_state')) as sp, list(f) filter (cat in ('sparse_event', 'discrete_state')) as spl, string_agg(f, '|' order by i) filter (cat = 'coverage_sensitive') as cov, count(*) as n from g1 group by k),
pr as (select k, p, j from fm, (select unnest({_list(g.ORDINARY)}) as p, unnest(range({len(g.ORDINARY)})) as j) where regexp_matches(expression, '\\b' || p || '\\s*\\(')),
g3 as (select k, string_agg(p, '|' order by j) as od, count(*) filter (p in ({", ".join(repr(p) for p in g.ALWAYS_UNSAFE)})) as au, string_agg(p, '|' order by j) filter (p in ({", ".join(repr(p) for p in g.COVERAGE_GUARDED)})) as cg from pr group by k),
ty as (select k, count(*) as t from fm, (select unnest({_list(g.TYPED)}) as p) where regexp_matches(expression, '\\b' || p || '\\s*\\(') group by k),
off as (select pr.k, string_agg(distinct p, '|' order by p) as o from pr join fm using (k) join g1 using (k) where cat in ('sparse_event', 'discrete_state') and regexp_matches(expression, '(?i)\\b' || p || '\\s*\\([^)]*\\$' || f || '\\b') group by pr.k),
gj as (select fm.k, expression, coalesce(n, 0) as n, lab, mem, sp, cov, coalesce(od, '') as od, coalesce(au, 0) as au, cg, coalesce(t, 0) as t, o from fm left join g2 using (k) left join g3 using (k) left join ty using (k) left join off using (k)),
gd as (select *, case when n = 0 and regexp_matches(lower(expression), 'future|label|next_') then 1 when n = 0 then 0 when lab is not null then 2 when mem is not null then 3 when sp is not null and od != '' and (o is not null or au > 0) then 4
  when sp is not null and od != '' then 5 when sp is not null and t = 0 then 5 when cov is not null and cg is not null and t = 0 then 6 else 0 end as v from gj),
gate as (select k, expression, case v when 0 then 'allow' when 1 then 'reject_label_or_future_field' when 2 then 'reject_label_or_future_field' when 3 then 'reject_membership_key_formula_input' when 4 then 'blocked_unsafe_known_structure' else 'require_typed_rewrite' end as typed_gate_decision,
  case v when 2 then lab when 3 then mem when 4 then sp when 5 then sp when 6 then cov else '' end as blocked_fields, case v when 2 then od when 3 then od when 4 then coalesce(o, od) when 5 then od when 6 then cg else '' end as blocked_primitives,
  case when v in (4, 5) then '{g.EVENT_REWRITE}' when v = 6 then '{g.COVERAGE_REWRITE}' else '' end as required_rewrite from gd)"""

#: Results of candidates, made of the customers.
RESULTS = f"""rs as (select c_custkey as position, 'h' || (c_custkey % 211) as expression_hash, (array[{', '.join(repr(t) for t in TEXTS)}])[c_custkey % {len(TEXTS)} + 1] as expression, 'lane' || (c_custkey % 4) as lane, c_custkey % 3 + 1 as horizon,
  case when c_custkey % 13 = 5 then null else c_acctbal / 120000 end as aligned_ic_mean, c_acctbal / 4000000 as aligned_spread_mean, (c_custkey % 90) / 100.0::double as spread_hit_rate, (c_custkey % 101) / 100.0::double as mean_one_way_turnover,
  (c_custkey % 5)::double as positive_horizon_count, abs(c_acctbal / 100000) as abs_aligned_ic_mean,
  case c_custkey % 7 when 0 then 'future_signal_wrong_lag_too_strong' when 1 then 'signal_corr_abs_ge_0.75|weak_dense_primary_abs_ic' when 2 then 'too_few_positive_horizons' else '' end as blocker_flags,
  case c_custkey % 6 when 0 then 'bp_followup_priority' when 1 then 'bl_pass' else 'watch' end as decision from customer)"""


def results(spark, sf_dir):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    flags = F.when(k % 7 == 0, "future_signal_wrong_lag_too_strong").when(k % 7 == 1, "signal_corr_abs_ge_0.75|weak_dense_primary_abs_ic").when(k % 7 == 2, "too_few_positive_horizons").otherwise("")
    return table(spark, sf_dir, "customer").select(
        k.alias("position"),
        F.concat(F.lit("h"), (k % 211).cast("string")).alias("expression_hash"),
        F.element_at(F.array(*map(F.lit, TEXTS)), (k % len(TEXTS) + 1).cast("int")).alias("expression"),
        F.concat(F.lit("lane"), (k % 4).cast("string")).alias("lane"),
        (k % 3 + 1).alias("horizon"),
        F.when(k % 13 != 5, bal / 120000).alias("aligned_ic_mean"),
        (bal / 4000000).alias("aligned_spread_mean"),
        ((k % 90) / 100.0).alias("spread_hit_rate"),
        ((k % 101) / 100.0).alias("mean_one_way_turnover"),
        (k % 5).cast("double").alias("positive_horizon_count"),
        F.abs(bal / 100000).alias("abs_aligned_ic_mean"),
        flags.alias("blocker_flags"),
        F.when(k % 6 == 0, "bp_followup_priority").when(k % 6 == 1, "bl_pass").otherwise("watch").alias("decision"),
    )


REWARDS = """rw as (select c_custkey as position, case when c_custkey % 29 = 3 then null else 'fam' || (c_custkey % 40) end as family_id, 'arm' || (c_custkey % 4) as generator_arm, cast(null as double) as optimizer_reward,
  c_acctbal / 10000 as train_reward, c_acctbal / 20000 + 0.1::double as proxy_quality, (c_custkey % 82) / 100.0::double as train_mean_one_way_turnover, case when c_custkey % 5 = 0 then 'extreme_turnover' else '' end as train_reward_blockers,
  case when c_custkey % 3 = 0 then 'HOLD_TRAIN_REWARD' else 'TRAIN_REWARD_FOLLOWUP_READY' end as train_reward_decision, case when c_custkey % 41 = 7 and c_custkey % 40 < 10 then 'signal_corr_abs_ge_0.75' else '' end as blocker_flags, cast(null as varchar) as inherited_blockers,
  (c_acctbal - 3000) / 9000 as validation_day_sortino, (c_custkey % 100) / 100.0::double as validation_mcmc_prob_gt_0 from customer),
mk as (select *, train_reward as reward, regexp_matches(lower(concat_ws('|', blocker_flags, train_reward_blockers, inherited_blockers)), 'wrong_lag|high_corr|signal_corr_abs') as lagged from rw),
mr as (select *, coalesce(family_id, 'unknown') as fam, coalesce(reward > 0 and train_mean_one_way_turnover <= 0.75 and train_reward_blockers = '' and contains(train_reward_decision, 'FOLLOWUP_READY') and not lagged, false) as clean,
  validation_day_sortino >= 0 or validation_mcmc_prob_gt_0 >= 0.55 as survivor, proxy_quality > 0 and train_reward <= 0 as hacked, train_mean_one_way_turnover > 0.75 as busy from mk),
ft0 as (select fam as family_id, count(*) as candidate_count, quantile_cont(reward, 0.5) as median_train_reward, count(*) filter (reward > 0) as positive_train_reward_count, count(*) filter (clean) as clean_count, count(*) filter (survivor) as survivor_count,
  count(*) filter (hacked) as hacked_count, count(*) filter (lagged) as lagged_count, count(*) filter (busy) as busy_count from mr group by 1),
ft1 as (select *, candidate_count / sum(candidate_count) over ()::double as family_share from ft0), ft2 as (select *, case when lagged_count > 0 then 'block' when hacked_count > 0 or busy_count > 0 then 'freeze' when family_share > 0.25 then 'downweight' else 'normal' end as base from ft1),
ft as (select *, case when base in ('normal', 'downweight') and clean_count > 0 then 'exploit_allowed' else base end as family_status, concat_ws('|', case when family_share > 0.25 then 'top_family_share_cap' end, case when hacked_count > 0 then 'proxy_high_cm_negative' end,
  case when lagged_count > 0 then 'wrong_lag_or_high_corr' end, case when busy_count > 0 and lagged_count = 0 then 'high_turnover' end, case when base in ('normal', 'downweight') and clean_count > 0 then 'train_optimizer_reward_positive' end) as family_reasons from ft2)"""


def rewards(spark, sf_dir):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    text = lambda start, n: F.concat(F.lit(start), n.cast("string"))
    raw = table(spark, sf_dir, "customer").select(
        k.alias("position"),
        F.when(k % 29 != 3, text("fam", k % 40)).alias("family_id"),
        text("arm", k % 4).alias("generator_arm"),
        F.lit(None).cast("double").alias("optimizer_reward"),
        (bal / 10000).alias("train_reward"),
        (bal / 20000 + 0.1).alias("proxy_quality"),
        ((k % 82) / 100.0).alias("train_mean_one_way_turnover"),
        F.when(k % 5 == 0, "extreme_turnover").otherwise("").alias("train_reward_blockers"),
        F.when(k % 3 == 0, "HOLD_TRAIN_REWARD").otherwise("TRAIN_REWARD_FOLLOWUP_READY").alias("train_reward_decision"),
        F.when((k % 41 == 7) & (k % 40 < 10), "signal_corr_abs_ge_0.75").otherwise("").alias("blocker_flags"),
        F.lit(None).cast("string").alias("inherited_blockers"),
        ((bal - 3000) / 9000).alias("validation_day_sortino"),
        ((k % 100) / 100.0).alias("validation_mcmc_prob_gt_0"),
    )
    return fb.reward_marks(raw)


def register(catalog: Catalog) -> None:
    catalog.add("expr_fields", lambda s, d: formulas(s).select("k", F.array_join(g.sorted_fields(F.col("expression")), "|").alias("fields")), f"with {FORMULAS} select k, array_to_string(list_sort(list_distinct(regexp_extract_all(expression, {FIELDS}, 1))), '|') as fields from fm")

    names = sorted({f for t in TEXTS for f in __import__("re").findall(r"\$(\w+)", t)} | {"code", "ctx_sent_up", "evt_uplimit_active", "m1_first5_bars", "label_1d", "sector", "vwap", "mystery", "float_share", "amplitude_pct"})
    listed = ", ".join(f"('{n}')" for n in names)

    @catalog.query("field_category", f"with v(f) as (values {listed}) select f as field, {case_sql('f', g.CATEGORIES, g.DEFAULT_CATEGORY)} as category, {case_sql('f', g.LANES, g.DEFAULT_LANE)} as lane from v")
    def field_category(spark, sf_dir):
        return spark.createDataFrame([(n,) for n in names], "field string").select("field", g.field_category(F.col("field")).alias("category"), g.field_lane(F.col("field")).alias("lane"))

    @catalog.query("typed_gate", f"with {FORMULAS}, {GATE_SQL} select * from gate")
    def typed_gate(spark, sf_dir):
        return g.typed_gate(formulas(spark))

    @catalog.query("g2_gate", f"with {FORMULAS}, {GATE_SQL} select k, case when typed_gate_decision = 'allow' and k % 6 != 0 then 'allowed' else 'rejected' end as side from gate")
    def g2_gate(spark, sf_dir):
        rows = formulas(spark).withColumn("upstream_rejection", F.when(F.col("k") % 6 == 0, "earlier").otherwise(""))
        allowed, rejected = g.split_by_gate(rows)
        return allowed.select("k", F.lit("allowed").alias("side")).unionAll(rejected.select("k", F.lit("rejected").alias("side")))

    calls = r"list_transform(regexp_extract_all(expression, '\b([A-Za-z][A-Za-z0-9_]*)\s*\(', 1), lambda c: lower(c))"
    depth = "list_max(list_transform(range(1, length(expression) + 1), lambda i: length(regexp_replace(left(expression, i), '[^(]', '', 'g')) - length(regexp_replace(left(expression, i), '[^)]', '', 'g'))))"

    @catalog.query(
        "cost_report",
        f"""with {FORMULAS}, c as (select *, {calls} as cs, cast({depth} as integer) as max_parenthesis_depth, cast(length(expression) as integer) as expression_length from fm),
        d as (select *, cast(len(cs) as integer) as operator_count, cast(len(list_filter(cs, lambda x: list_contains({_list(g.RELATIONS)}, x))) as integer) as relation_operator_count, cast(len(list_filter(cs, lambda x: list_contains({_list(g.ROLLINGS)}, x))) as integer) as rolling_operator_count from c)
        select k, expression, max_parenthesis_depth, expression_length, operator_count, relation_operator_count, rolling_operator_count,
        case when relation_operator_count = 0 and rolling_operator_count <= 4 then 'cheap_fast_path' when relation_operator_count <= 2 and rolling_operator_count <= 8 then 'moderate_fast_path' when relation_operator_count <= 8 then 'slow_relation_path' else 'very_slow_nested_relation_path' end as validation_lane,
        case when starts_with(expression, 'Sign(') then 'group_spread_regime_shadow' else 'cross_sectional_rank_validation' end as validation_role,
        round(expression_length / 50.0::double + rolling_operator_count * 2.0 + relation_operator_count * 8.0 + max_parenthesis_depth * 1.5, 3) as estimated_cost from d""",
    )
    def cost_report(spark, sf_dir):
        return g.cost_report(formulas(spark)).withColumn("estimated_cost", rnd(F.col("estimated_cost"), 3))

    known = f"list_filter(regexp_extract_all(expression, '\\b([A-Za-z][A-Za-z0-9_]*)\\s*\\(', 1), lambda c: list_contains({_list(g.KNOWN)}, c))"
    bins = lambda c, p: "case " + " ".join(f"when {c} <= {e} then '{p}_le_{e}'" for e in g.BINS[p]) + f" else '{p}_gt_{g.BINS[p][-1]}' end"

    @catalog.query(
        "ast_features",
        f"""with {FORMULAS}, a as (select *, {known} as cs, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(expression, ',\\s*(\\d+)\\s*\\)', 1), lambda w: cast(w as integer)), lambda w: w between 1 and 252))) as ws,
          list_distinct(regexp_extract_all(expression, {FIELDS}, 1)) as fs, greatest({depth}, 0) as d from fm),
        b as (select *, len(cs) as n, len(fs) as f, len(ws) as w, coalesce(list_max(ws), 0) as mw from a)
        select k, left(regexp_replace(regexp_replace(regexp_replace(expression, '\\$[A-Za-z_][A-Za-z0-9_]*', '$F', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', 'N', 'g'), '\\s+', '', 'g'), 240) as ast_skeleton,
        case when n = 0 then 'none' else array_to_string(cs[1:10], '>') end as ast_operator_sequence, case when n = 0 then 'none' else array_to_string(list_transform(list_sort(list_distinct(cs)), lambda c: c || ':' || len(list_filter(cs, lambda x: x = c))), '|') end as ast_operator_multiset,
        coalesce(cs[1], 'none') as ast_root_operator, {bins("d", "depth")} as ast_depth_bin, {bins("n", "opcount")} as ast_operator_count_bin, {bins("f", "fieldcount")} as ast_field_count_bin, {bins("w", "wincount")} as ast_window_count_bin,
        {bins("mw", "maxwin")} as ast_max_window_bin, {bins("(n + f + w)", "complexity")} as ast_complexity_bin from b""",
    )
    def ast_features(spark, sf_dir):
        return g.shape_features(formulas(spark)).select("k", *fb.SHAPE_KINDS)

    @catalog.query("max_window")
    def max_window(spark, sf_dir):
        from spindrift.plans.expr import UnsupportedExpression, depth, max_window, parse

        rows = []
        for k, t in enumerate(TEXTS):
            try:
                rows.append((k, max_window(parse(t)), depth(parse(t)), ""))
            except UnsupportedExpression as no:
                rows.append((k, None, None, str(no)))
        return spark.createDataFrame(rows, "k int, max_window int, depth int, error string")

    kinds = list(dict.fromkeys([c for c, _ in g.CATEGORIES] + [g.DEFAULT_CATEGORY]))

    @catalog.query(
        "primitive_matrix",
        f"""select p as primitive, c as category, case when c in ('text_or_label', 'timestamp_or_key') then 'reject' when c = 'membership_or_group_key' then 'reject_membership' when list_contains({_list(g.TYPED)}, p) then 'allow_typed'
        when c in ('sparse_event', 'discrete_state') then case when list_contains({_list(g.ALWAYS_UNSAFE)}, p) then 'block' else 'typed_rewrite' end when c = 'coverage_sensitive' and list_contains({_list(g.COVERAGE_GUARDED)}, p) then 'coverage_guard' else 'allow' end as decision
        from (select unnest({_list(g.ORDINARY + g.TYPED)}) as p), (select unnest({_list(kinds)}) as c)""",
    )
    def primitive_matrix(spark, sf_dir):
        return g.primitive_matrix(spark)

    motif = " union all ".join(f"select path, line_no, text, '{n}' as motif from ln where regexp_matches(text, '{p}')" for n, p in g.MOTIFS.items())
    lines = f"{FORMULAS}, ln as (select 'file' || (k % 3) as path, k // 2 as line_no, expression as text from fm)"

    def _lines(spark):
        return formulas(spark).select(F.concat(F.lit("file"), (F.col("k") % 3).cast("string")).alias("path"), F.floor(F.col("k") / 2).cast("int").alias("line_no"), F.col("expression").alias("text"))

    @catalog.query("motif_scan", f"with {lines} select distinct * from ({motif})")
    def motif_scan(spark, sf_dir):
        return g.scan_motifs(_lines(spark))

    @catalog.query("quarantine_summary", f"with {lines} select path, motif, count(*) as hits, min(line_no) as first_line from (select distinct * from ({motif})) group by 1, 2")
    def quarantine_summary(spark, sf_dir):
        return g.motif_summary(g.scan_motifs(_lines(spark)))

    @catalog.query("hard_blocker", f"with {RESULTS} select position, regexp_matches(lower(concat_ws('|', blocker_flags, decision)), 'future_signal_wrong_lag|hard_reject|signal_corr_abs') as blocked from rs")
    def hard_blocker(spark, sf_dir):
        r = results(spark, sf_dir)
        return r.select("position", g.hard_blocked(r).alias("blocked"))

    available = ["close", "volume", "amount", "open", "ret", "turnover_ratio", "limit_up_streak", "pe_ttm"]

    @catalog.query(
        "cm_gate",
        f"""with {RESULTS}, m as (select position, array_to_string(list_filter(list_sort(list_distinct(regexp_extract_all(expression, {FIELDS}, 1))), lambda f: not list_contains({_list(available)}, f)), '|') as missing_fields, mean_one_way_turnover as t from rs)
        select position, missing_fields, case when missing_fields != '' then 'missing_fields' when t > 0.75 then 'turnover_proxy_above_cap' else 'pass' end as gate_status from m""",
    )
    def cm_gate(spark, sf_dir):
        return g.feasible(results(spark, sf_dir), available).select("position", "missing_fields", "gate_status")

    lane = case_sql("f", g.LANES, g.DEFAULT_LANE)

    @catalog.query(
        "formula_class",
        f"""with {FORMULAS}, x as (select k, expression, unnest(list_distinct(regexp_extract_all(expression, {FIELDS}, 1))) as f from fm), y as (select expression, bool_or({lane} = 'blocked_key_or_label' or f in ('industry_code')) as bad, bool_or(not list_contains({_list(names[:-3])}, f)) as gone,
          bool_or(f in ('amount')) as day, bool_or({lane} = 'event_state') as ev, bool_or({lane} = 'lagged_context') as ctx from x group by 1)
        select expression, case when coalesce(bad, false) or coalesce(gone, false) then 'blocked' when coalesce(day, false) then 'diagnostic' when coalesce(ev, false) then 'event' when coalesce(ctx, false) then 'context' else 'direct' end as formula_class from fm left join y using (expression)""",
    )
    def formula_class(spark, sf_dir):
        return g.formula_class(formulas(spark), names[:-3], ["industry_code"], ["amount"])

    @catalog.query("memory_view", f"with {FORMULAS}, {GATE_SQL} select k, case when typed_gate_decision = 'allow' then 'kept' else 'blocked' end as memory_status, case when typed_gate_decision = 'allow' then k / 10.0::double end as credit from gate")
    def memory_view(spark, sf_dir):
        return g.memory_view(formulas(spark).withColumn("reward", F.col("k") / 10.0)).select("k", "memory_status", "credit")

    dec = f"""{RESULTS}, pw as (select 'h' || s_suppkey % 211 as l, 'h' || (s_suppkey * 7) % 211 as r, s_acctbal / 12000 as c from supplier), cr as (select l as h from pw where abs(c) >= 0.75 union select r from pw where abs(c) >= 0.75),
    dg as (select expression_hash, arg_max(horizon, (abs(coalesce(aligned_ic_mean, 0)), -horizon)) as horizon, arg_max({{'a': aligned_ic_mean}}, (abs(coalesce(aligned_ic_mean, 0)), -horizon)).a as aligned_ic_mean, arg_max(mean_one_way_turnover, (abs(coalesce(aligned_ic_mean, 0)), -horizon)) as turn,
      count(*) filter (abs(coalesce(aligned_ic_mean, 0)) > 0.02) as positive_horizon_count, count(*) filter (contains(blocker_flags, 'future_signal_wrong_lag_too_strong')) as wl from rs group by 1),
    dc as (select *, abs(aligned_ic_mean) as ai, concat_ws('|', case when expression_hash in (select h from cr) then 'signal_corr_abs_ge_0.75' end, case when wl > 0 then 'future_signal_wrong_lag_too_strong' end, case when positive_horizon_count < 2 then 'too_few_positive_horizons' end,
      case when turn > 0.95 then 'extreme_turnover' end, case when aligned_ic_mean is null or abs(aligned_ic_mean) <= 0.03 then 'weak_dense_primary_abs_ic' end) as blocker_flags, expression_hash[-1:] as tail from dg),
    dd as (select *, case when blocker_flags = '' and ai > 0.035 then 'bp_followup_priority' else 'bp_watch_or_reject' end as decision from dc)"""

    def _decisions(spark, sf_dir):
        key = F.col("s_suppkey")
        h = lambda n: F.concat(F.lit("h"), (n % 211).cast("string"))
        pairs = table(spark, sf_dir, "supplier").select(h(key).alias("left"), h(key * 7).alias("right"), (F.col("s_acctbal") / 12000).alias("signal_rank_corr"))
        return fb.decide(results(spark, sf_dir), pairs)

    @catalog.query("bp_decisions", f"with {dec} select expression_hash, horizon, round(ai, 6) as abs_aligned_ic_mean, positive_horizon_count, wl as future_wrong_lag_horizon_count, blocker_flags, case when aligned_ic_mean >= 0 then 'long_top' else 'short_top' end as open_direction, decision from dd")
    def bp_decisions(spark, sf_dir):
        d = _decisions(spark, sf_dir)
        return d.select("expression_hash", "horizon", rnd(F.col("abs_aligned_ic_mean")).alias("abs_aligned_ic_mean"), "positive_horizon_count", "future_wrong_lag_horizon_count", "blocker_flags", "open_direction", "decision")

    @catalog.query(
        "summarize_by",
        f"with {dec} select tail as lane, count(*) as count, round(max(abs(coalesce(aligned_ic_mean, 0))), 6) as best_abs_aligned_ic, count(*) filter (decision = 'bp_followup_priority') as followup_count, count(*) filter (contains(blocker_flags, 'future_signal_wrong_lag_too_strong')) as future_wrong_lag_count from dd group by 1",
    )
    def summarize_by(spark, sf_dir):
        d = _decisions(spark, sf_dir).withColumn("lane", F.right("expression_hash", F.lit(1)))
        return fb.summarize_by(d, "lane").withColumn("best_abs_aligned_ic", rnd(F.col("best_abs_aligned_ic")))

    fut, cro = "contains(blocker_flags, 'future_signal_wrong_lag_too_strong')", "contains(blocker_flags, 'signal_corr_abs')"
    bsq = f"greatest(least(0.75 * least(abs(coalesce(abs_aligned_ic_mean, 0)), 0.25) + 0.025 * least(coalesce(positive_horizon_count, 0), 4) + case when {fut} then -0.22 else 0.04 end - case when {cro} then 0.07 else 0 end - case when mean_one_way_turnover > 0.95 then 0.04 else 0 end - case when mean_one_way_turnover < 0.25 then 0.015 else 0 end, 0.35), -0.35)"
    elig = f"(not {fut} and not {cro} and mean_one_way_turnover <= 0.98 and abs(coalesce(abs_aligned_ic_mean, 0)) >= 0.025 and coalesce(positive_horizon_count, 0) >= 1)"
    caq = f"least(abs(coalesce(aligned_ic_mean, 0)), 0.3) * 2.2 + least(abs(coalesce(aligned_spread_mean, 0)), 0.002) * 80 + greatest(spread_hit_rate - 0.5, 0) * 0.3 + least(positive_horizon_count, 4) * 0.035 - greatest(mean_one_way_turnover - 0.55, 0) * 0.45 - case when {fut} then 0.8 else 0 end - case when {cro} then 0.18 else 0 end"

    @catalog.query("bs_quality", f"with {RESULTS} select position, round({bsq}, 6) as quality, {elig} as eligible from rs")
    def bs_quality(spark, sf_dir):
        return results(spark, sf_dir).select("position", rnd(fb.round_quality()).alias("quality"), fb.feedback_eligible().alias("eligible"))

    @catalog.query("ca_quality", f"with {RESULTS} select position, round({caq}, 6) as quality from rs")
    def ca_quality(spark, sf_dir):
        return results(spark, sf_dir).select("position", rnd(fb.audit_quality()).alias("quality"))

    @catalog.query(
        "bridge_table",
        f"""with {RESULTS}, q as (select *, {caq} as proxy_quality from rs where not {fut} and not {cro}), u as (select *, row_number() over (partition by expression_hash order by proxy_quality desc, position) as r from q)
        select expression_hash, position, round(proxy_quality, 6) as proxy_quality from u where r = 1 order by proxy_quality desc, expression_hash limit 60""",
    )
    def bridge_table(spark, sf_dir):
        return fb.bridge_table(results(spark, sf_dir), 60).select("expression_hash", "position", rnd(F.col("proxy_quality")).alias("proxy_quality"))

    counts = "candidate_count, positive_train_reward_count, clean_count, survivor_count, hacked_count, lagged_count, busy_count, family_status, family_reasons"

    @catalog.query("family_table", f"with {REWARDS} select family_id, {counts}, round(median_train_reward, 6) as median_train_reward, round(family_share, 6) as family_share from ft")
    def family_table(spark, sf_dir):
        f = fb.family_table(rewards(spark, sf_dir))
        return f.select("family_id", *counts.split(", "), rnd(F.col("median_train_reward")).alias("median_train_reward"), rnd(F.col("family_share")).alias("family_share"))

    @catalog.query(
        "arm_scores",
        f"""with {REWARDS}, bf as (select generator_arm, fam, count(*) as n, bool_or(fam in (select family_id from ft where family_status = 'exploit_allowed')) as op from mr group by 1, 2),
        sp as (select generator_arm, count(*) as fams, max(n) as top, count(*) filter (op) as exploit_allowed_family_count from bf group by 1),
        ow as (select generator_arm, count(*) as candidate_count, count(*) filter (clean) as clean_feedback_count, quantile_cont(reward, 0.5) as med, avg(case when reward > 0 then 1.0 else 0.0 end) as pos, avg(case when hacked then 1.0 else 0.0 end) as hk, avg(case when lagged then 1.0 else 0.0 end) as lg,
          avg(case when train_mean_one_way_turnover <= 0.75 then 1.0 else 0.0 end) as calm from mr group by 1)
        select generator_arm, candidate_count, clean_feedback_count, exploit_allowed_family_count, clean_feedback_count >= 32 as feedback_update_allowed, round(pos + med + fams / candidate_count::double + calm - hk - lg - top / candidate_count::double, 6) as arm_score from ow join sp using (generator_arm)""",
    )
    def arm_scores(spark, sf_dir):
        marked = rewards(spark, sf_dir)
        a = fb.arm_scores(marked, fb.family_table(marked))
        return a.select("generator_arm", "candidate_count", "clean_feedback_count", "exploit_allowed_family_count", "feedback_update_allowed", rnd(F.col("arm_score")).alias("arm_score"))

    @catalog.query(
        "family_actions",
        f"""with {REWARDS} select family_id, case family_status when 'block' then 'block' when 'freeze' then 'freeze' when 'exploit_allowed' then 'allow_followup' when 'downweight' then 'downweight' else 'observe' end as scheduler_action,
        case when family_status in ('block', 'freeze') then 0 when family_status = 'exploit_allowed' then 50 else 25 end as candidate_budget_cap from ft""",
    )
    def family_actions(spark, sf_dir):
        return fb.family_actions(fb.family_table(rewards(spark, sf_dir)), 200)

    keyed = f"""ks as (select *, {known} as cs, list_distinct(list_filter(regexp_extract_all(expression, ',\\s*(\\d+)\\s*\\)', 1), lambda w: cast(w as integer) between 1 and 252)) as ws, list_sort(list_distinct(regexp_extract_all(expression, {FIELDS}, 1))) as fs from {{0}}),
    kk as (select *, 'lane' as kind, lane as key from ks union all select *, 'fieldset', array_to_string(fs, '|') from ks union all select *, 'ast_root_operator', coalesce(cs[1], 'none') from ks
      union all select *, 'field', unnest(fs) from ks union all select *, 'operator', unnest(list_distinct(cs)) from ks union all select *, 'window', unnest(ws) from ks)"""
    prior = "greatest(least(abs(coalesce(aligned_ic_mean, 0)) + case when contains(decision, 'followup_priority') then 0.035 else 0 end + case when contains(decision, 'pass') then 0.015 else 0 end - case when contains(blocker_flags, 'future_signal_wrong_lag_too_strong') then 0.18 else 0 end - case when contains(blocker_flags, 'signal_corr_abs') then 0.06 else 0 end - case when contains(blocker_flags, 'weak_dense') then 0.04 else 0 end - case when contains(blocker_flags, 'too_few_positive_horizons') then 0.03 else 0 end, 0.25), -0.25)"
    checked = ["lane", "fieldset", "field", "operator", "window", "ast_root_operator"]
    ucb = f"{RESULTS}, pr0 as (select *, {prior} as reward from rs), {keyed.format('pr0')}, pol as (select kind, key, avg(reward) + 0.45::double * sqrt(ln(greatest(2, (select count(*) from pr0) + 1)) / count(*)) as score from kk group by 1, 2)"

    def _policy(spark, sf_dir):
        return fb.ucb_policy(results(spark, sf_dir)).where(F.col("kind").isin(checked))

    @catalog.query("ucb_policy", f"with {ucb} select kind, key, round(score, 6) as score from pol")
    def ucb_policy(spark, sf_dir):
        return _policy(spark, sf_dir).withColumn("score", rnd(F.col("score")))

    @catalog.query(
        "policy_feedback",
        f"""with {ucb}, el as (select *, {bsq} as credit from rs where {elig}), {keyed.format("el").replace("ks as", "ks2 as").replace("from ks", "from ks2").replace("kk as", "kk2 as")}, er as (select kind, key, avg(credit) as credit from kk2 group by 1, 2)
        select coalesce(p.kind, e.kind) as kind, coalesce(p.key, e.key) as key, round(case when credit is null then score else greatest(least(0.45::double * coalesce(score, 0.015) + 0.55::double * credit, 1.25), 0.015) end, 6) as score from pol p full join er e on p.kind = e.kind and p.key = e.key""",
    )
    def policy_feedback(spark, sf_dir):
        out = fb.policy_feedback(_policy(spark, sf_dir), results(spark, sf_dir)).where(F.col("kind").isin(checked))
        return out.withColumn("score", rnd(F.col("score")))

    @catalog.query("policy_blend", f"with {ucb} select kind, key, round(score * 0.25::double + greatest(score * 1.2 + 0.02, 0.02) * 0.75::double, 6) as score from pol")
    def policy_blend(spark, sf_dir):
        p = _policy(spark, sf_dir)
        return fb.blend([(p, 1.0), (fb.boost(p, 1.2, 0.02), 3.0)]).withColumn("score", rnd(F.col("score")))

    @catalog.query("policy_score")
    def policy_score(spark, sf_dir):
        candidates = formulas(spark).select(F.concat(F.lit("h"), F.col("k").cast("string")).alias("expression_hash"), "expression", F.lit("lane1").alias("lane"))
        return fb.policy_score(candidates, fb.ucb_policy(results(spark, sf_dir)))

    @catalog.query("policy_ext_feedback")
    def policy_ext_feedback(spark, sf_dir):
        marked = rewards(spark, sf_dir)
        texts = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("position") % len(TEXTS) + 1).cast("int"))
        return fb.policy_reward_feedback(fb.ucb_policy(results(spark, sf_dir)), marked.withColumns({"expression": texts, "lane": F.lit("lane1")}))

    @catalog.query("arm_schedule")
    def arm_schedule(spark, sf_dir):
        rows = {r["generator_arm"]: r.asDict() for r in fb.arm_scores(rewards(spark, sf_dir), fb.family_table(rewards(spark, sf_dir))).collect()}
        renamed = {a.name: rows[k] for a, k in zip(fb.ARMS, sorted(rows), strict=False)}
        out = fb.schedule_arms(renamed, exploit_families=3, total=512)
        return spark.createDataFrame(out, "arm_id string, category string, health_score double, scheduler_action string, candidate_budget long")

    @catalog.query(
        "field_coverage",
        """with d as (select distinct cast(date_trunc('month', l_shipdate) as date) as date from lineitem), p as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from d),
        s as (select date, case when i < floor(n * 0.6) then 'train' when i < floor(n * 0.8) then 'validation' else 'test' end as split from p),
        c as (select distinct l_suppkey, cast(date_trunc('month', l_shipdate) as date) as date from lineitem), x as (select split, (l_suppkey + month(date)) % 7 = 0 as gap from c join s using (date))
        select split, 'gappy' as field, count(*) as rows, count(*) filter (not gap) as nonnull, round(count(*) filter (not gap) / count(*)::double, 6) as nonnull_ratio from x group by 1""",
    )
    def field_coverage(spark, sf_dir):
        panel = daily_panel(spark, sf_dir)
        split = panel.join(audit_split(panel), "date")
        long = split.select("split", F.inline(F.array(F.struct(F.lit("gappy").alias("field"), F.col("gappy").alias("v")))))
        return long.groupBy("split", "field").agg(F.count("*").alias("rows"), F.count("v").alias("nonnull"), rnd(F.count("v") / F.count("*")).alias("nonnull_ratio"))

    @catalog.query("sum_min_count", "select c_nationkey as code, sum(case when c_custkey % 3 = 0 or c_nationkey % 5 = 2 then null else round(c_acctbal, 2)::decimal(18,2) end)::double as total from customer group by 1")
    def sum_min_count(spark, sf_dir):
        value = F.when((F.col("c_custkey") % 3 != 0) & (F.col("c_nationkey") % 5 != 2), F.col("c_acctbal").cast("decimal(18,2)"))
        return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(F.sum(value).cast("double").alias("total"))

    @catalog.query(
        "bucket_prefilter",
        """with p as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by round(c_acctbal, 2) desc, c_custkey desc) as r, case c_mktsegment when 'AUTOMOBILE' then 30 when 'BUILDING' then 12 when 'MACHINERY' then 18 else 25 end as cap from customer)
        select c_custkey, c_mktsegment from p where r <= cap""",
    )
    def bucket_prefilter(spark, sf_dir):
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc(F.round("c_acctbal", 2)), F.desc("c_custkey")))
        cap = F.when(F.col("c_mktsegment") == "AUTOMOBILE", 30).when(F.col("c_mktsegment") == "BUILDING", 12).when(F.col("c_mktsegment") == "MACHINERY", 18).otherwise(25)
        return table(spark, sf_dir, "customer").withColumn("place", place).where(F.col("place") <= cap).select("c_custkey", "c_mktsegment")

    @catalog.query(
        "field_usage",
        f"""with {RESULTS}, x as (select unnest(list_distinct(regexp_extract_all(expression, {FIELDS}, 1))) as f, expression_hash, aligned_ic_mean from rs) select f as field, {lane} as lane, count(*) as uses, count(distinct expression_hash) as formulas,
        count(*) filter (abs(aligned_ic_mean) > 0.02) as effective, list_contains({_list(available)}, f) as available from x group by f""",
    )
    def field_usage(spark, sf_dir):
        x = results(spark, sf_dir).select(F.explode(g.sorted_fields(F.col("expression"))).alias("field"), "expression_hash", "aligned_ic_mean")
        used = x.groupBy("field").agg(F.count("*").alias("uses"), F.count_distinct("expression_hash").alias("formulas"), F.count_if(F.abs("aligned_ic_mean") > 0.02).alias("effective"))
        return used.select("field", g.field_lane(F.col("field")).alias("lane"), "uses", "formulas", "effective", F.col("field").isin(available).alias("available"))
