"""Generation, learning rounds, ledgers and watch lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.catalog import Catalog, load
from spindrift.catalog.reports import FIELDS, FORMULAS, RESULTS, TEXTS, formulas, results
from spindrift.functions.numeric import steady_round as rnd
from spindrift.operators import feedback as fb
from spindrift.operators import ledgers as led
from spindrift.operators import metrics as m
from spindrift.operators import search as s
from spindrift.operators.gates import sorted_fields, typed_gate
from spindrift.plans.compiler import evaluate
from spindrift.session import shared_folder
from spindrift.sources.panels import minute_panel, table

AVAILABLE = ["open", "high", "low", "close", "volume", "amount", "vwap", "pct_chg", "ctx_sent_up", "ctx_zls_strong", "evt_uplimit_active", "limit_up_streak", "m1_first5_amount", "m1_first5_range", "m1_first15_vwap", "code", "trade_time"]


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


COLUMNS = "expression_hash string, expression string, lane string, note string, fields string, policy_score double, generator_arm string"


def _generator(spark, sf_dir):
    memory = spark.createDataFrame([("nothing",)], "expression_hash string")
    return s.Generator(spark, AVAILABLE, fb.ucb_policy(results(spark, sf_dir)), memory)


def _arm(name: str, limit: int = 40):
    def run(spark, sf_dir):
        rows = _generator(spark, sf_dir).arm(name, limit)
        return spark.createDataFrame([tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) for r in rows], COLUMNS)

    return run


def measure(panel, horizons=(1, 5, 15, 30), shard: str | None = None):
    """Measures candidates on a panel: metrics by formula and horizon, and how alike the formulas' ranks are.

    Correlation, spread, turnover and both wrong lags come from the same signals. They stay
    wide while formulas are worked out; then one sort of long rows ranks all of them, and
    labels are ranked once. With ``shard`` every shard is measured by itself and the shards'
    metrics are averaged. The ranks of one batch are kept until the next, or until ``release``.
    """
    held: list = []

    def release() -> None:
        while held:
            held.pop().unpersist()

    def run(rows: list[dict]):
        release()
        names = {f"f{k}": r["expression_hash"] for k, r in enumerate(rows)}
        own = [shard] if shard else []
        wide = evaluate(panel, {n: r["expression"] for n, r in zip(names, rows, strict=True)})
        wide = wide.withColumns({f"__r{h}": m.forward_return(wide, h) for h in horizons})
        wide = wide.withColumns({f"__l{h}": m.section_rank(f"__r{h}", [*own, "trade_time"]) for h in horizons})
        kept = ["code", "trade_time", *own, *[f"__{x}{h}" for h in horizons for x in "rl"]]
        by = ["expression_hash", *own]
        signals = m.lagged_signals(wide.select(*kept, *names), names, kept)
        ranked = signals.withColumn("signal_rank", m.section_rank("signal", [*by, "which", "trade_time"])).persist()
        held.append(ranked)
        found = m.batch_metrics(ranked, list(horizons), by)
        if shard:
            found = m.shard_aggregate(found, ["expression_hash", "horizon"])
        metrics = m.score_flags(found.withColumn("expected_direction", F.lit(1)))
        # The ranks of a code at a time, in order of the formulas' keys: as many as the batch has.
        keys = sorted(set(names.values()))
        rank = F.struct("expression_hash", "signal_rank")
        vectors = ranked.where("which = 'now'").groupBy("code", "trade_time", *own).agg(F.sort_array(F.collect_list(rank))["signal_rank"].alias("v"))
        return metrics, m.vector_correlation(vectors.select("v"), keys)

    run.release = release
    return run


EVALS = f"""ev as (select position, lane, 'src' || (position % 3) as source, 'cell' || (position % 45) as cell, array_to_string(list_sort(list_distinct(regexp_extract_all(expression, {FIELDS}, 1))), '|') as fields, decision = 'bp_followup_priority' as passed, aligned_ic_mean as mean_ic from rs)"""


def register(catalog: Catalog) -> None:
    @catalog.query("atoms")
    def atoms(spark, sf_dir):
        return s.atom_table(spark, AVAILABLE)

    for name in ("rx_ucb", "event_state", "turnover_aware", "cem_elite", "hybrid"):
        catalog.add({"rx_ucb": "gen_rx_ucb", "event_state": "gen_event_state", "turnover_aware": "gen_turnover", "cem_elite": "gen_cem", "hybrid": "gen_hybrid"}[name], _arm(name))

    @catalog.query("loop_adaptive")
    def loop_adaptive(spark, sf_dir):
        panel = minute_panel(spark, sf_dir).select("code", "trade_time", "date", "open", "high", "low", "close", "volume", "amount").cache()
        memory = spark.createDataFrame([("nothing",)], "expression_hash string")
        policy = fb.ucb_policy(results(spark, sf_dir))
        rounds = s.adaptive_rounds(spark, ["open", "high", "low", "close", "volume", "amount"], policy, memory, measure(panel), ["rx_ucb", "cem_elite"], limit=8, least=2)
        return spark.createDataFrame(rounds, "round int, arm string, candidates int, followups long, best_abs_ic double")

    @catalog.query("atom_inventory")
    def atom_inventory(spark, sf_dir):
        a = s.atom_table(spark, AVAILABLE)
        gated = typed_gate(a.select(F.concat(F.lit("CSRank("), s.normalized(), F.lit(")")).alias("expression"), "lane", "role"))
        return gated.groupBy("role", "lane", "typed_gate_decision").agg(F.count("*").alias("atoms"))

    @catalog.query(
        "replay_objective",
        f"""with {RESULTS}, {EVALS}, k as (select 'lane' as "group", lane as key, passed, mean_ic from ev union all select 'source', source, passed, mean_ic from ev union all select 'cell', cell, passed, mean_ic from ev union all select 'field', unnest(list_filter(string_split(fields, '|'), lambda f: f != '')), passed, mean_ic from ev),
        a as (select "group", key, count(*) as evaluations, count(*) filter (passed) as passed, avg(mean_ic) as mi from k group by 1, 2),
        w as (select "group", key, 'watched' as status from a where passed = 0 and mi > 0 order by mi desc, "group", key limit 8), dm as (select "group", key, 'demoted' as status from a where passed = 0 and evaluations >= 2 and coalesce(mi, 0) <= 0 order by mi nulls first, evaluations desc, "group", key limit 12)
        select "group", key, evaluations, passed, round(passed / evaluations::double, 6) as pass_rate, round(mi, 6) as mean_ic, coalesce(w.status, dm.status, 'neutral') as status from a left join w using ("group", key) left join dm using ("group", key)""",
    )
    def replay_objective(spark, sf_dir):
        r = results(spark, sf_dir)
        text = lambda start, n: F.concat(F.lit(start), (F.col("position") % n).cast("string"))
        ev = r.select("lane", text("src", 3).alias("source"), text("cell", 45).alias("cell"), F.array_join(sorted_fields(F.col("expression")), "|").alias("fields"), (F.col("decision") == "bp_followup_priority").alias("passed"), F.col("aligned_ic_mean").alias("mean_ic"))
        return led.replay_objective(ev).withColumns({"pass_rate": rnd(F.col("pass_rate")), "mean_ic": rnd(F.col("mean_ic"))})

    shapes = catalog.oracle["ast_features"]

    @catalog.query(
        "round_metrics",
        f"""with {RESULTS}, sh as (select k, concat_ws('|', ast_depth_bin, ast_operator_count_bin, ast_field_count_bin, ast_complexity_bin) as shape from ({shapes})),
        d as (select *, abs(coalesce(nullif(abs_aligned_ic_mean, 0), aligned_ic_mean, 0)) as ic, contains(blocker_flags, 'future_signal_wrong_lag_too_strong') as fu, contains(blocker_flags, 'signal_corr_abs') as cr, array_to_string(list_sort(list_distinct(regexp_extract_all(expression, {FIELDS}, 1))), '|') as fs from rs join sh on sh.k = position % {len(TEXTS)}),
        t as (select coalesce(avg(ic), 0) as tm from (select ic from d order by ic desc limit 10)),
        a as (select count(*) as candidates, count(*) filter (fu or cr) as hard_blocked, count(*) filter (not fu) as non_future, count(*) filter (not fu and mean_one_way_turnover <= 0.98 and ic >= 0.025 and positive_horizon_count >= 1) as research_pool, count(distinct nullif(lane, '')) as lanes, count(distinct nullif(fs, '')) as fieldsets, count(distinct shape) filter (expression != '') as shapes, max(ic) as best from d)
        select candidates, hard_blocked, non_future, research_pool, lanes, fieldsets, shapes, round(best, 6) as best_abs_ic, round(tm, 6) as top10_abs_ic_mean,
        round(0.45::double * research_pool / greatest(candidates, 1) + 0.2::double * non_future / greatest(candidates, 1) + 0.15::double * least(1, lanes / 18.0::double) + 0.12::double * least(1, fieldsets / 30.0::double) + 0.08::double * least(1, shapes / 24.0::double) + 0.08::double * least(1, tm / 0.08::double), 6) as round_score from a, t""",
    )
    def round_metrics(spark, sf_dir):
        out = led.round_metrics(results(spark, sf_dir))
        return out.withColumns({c: rnd(F.col(c)) for c in ("best_abs_ic", "top10_abs_ic_mean", "round_score")})

    present = ["close", "volume", "amount"]

    @catalog.query(
        "pack_preflight",
        f"""with {RESULTS}, x as (select lane, expression, unnest(list_distinct(regexp_extract_all(expression, {FIELDS}, 1))) as field from rs)
        select field, string_agg(distinct lane, '|' order by lane) as lanes, count(distinct expression) as formulas, field in ('close', 'volume', 'amount') as present from x group by field""",
    )
    def pack_preflight(spark, sf_dir):
        return led.pack_preflight(results(spark, sf_dir).select("lane", "expression", sorted_fields(F.col("expression")).alias("fields")), present)

    families = [*led.FAMILY_WEIGHTS, "other"]
    stated = f"""case {{k}} % 5 when 0 then 'blocked' when 1 then 'backlog' when 2 then 'ready' end as asset_status, case when {{k}} % 8 = 3 then 'Probe_v2' else 'registry' end as source_registry, case when {{k}} % 11 = 5 then 'a_PROBE' end as source_group,
      (array{families})[{{k}} % {len(families)} + 1] as field_family, (array['very_high', 'High', 'medium', 'low', ''])[{{k}} % 5 + 1] as priority"""

    def _stated(k):
        pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (k % n + 1).cast("int"))
        return [
            F.when(k % 5 == 0, "blocked").when(k % 5 == 1, "backlog").when(k % 5 == 2, "ready").alias("asset_status"),
            F.when(k % 8 == 3, "Probe_v2").otherwise("registry").alias("source_registry"),
            F.when(k % 11 == 5, "a_PROBE").alias("source_group"),
            pick(families, len(families)).alias("field_family"),
            pick(["very_high", "High", "medium", "low", ""], 5).alias("priority"),
        ]

    weigh = lambda c, weights: f"case {c} " + " ".join(f"when '{k}' then {v}::double" for k, v in weights.items()) + " else 0::double end"
    integration = f"""js as (select *, case when coalesce(blocked_or_metadata, false) then 'blocked_or_metadata' when coalesce(selector_selected, false) then 'integrated_selector_selected' when coalesce(factor_pack_referenced, false) and coalesce(panel_materialized, false) then 'integrated_selector_ready'
      when coalesce(panel_materialized, false) then 'panel_only' when coalesce(factor_pack_referenced, false) then 'factor_pack_only_missing_panel' when coalesce(asset_status in ('blocked', 'backlog'), false) or contains(lower(coalesce(source_registry, '')), 'probe') or contains(lower(coalesce(source_group, '')), 'probe') then 'probe_or_backlog' else 'contract_only' end as integration_status from fs),
    ps as (select *, {weigh("integration_status", led.STATE_WEIGHTS)} + {weigh("field_family", led.FAMILY_WEIGHTS)} + {weigh("lower(priority)", led.PRIORITY_WEIGHTS)} + case when coalesce(factor_pack_referenced, false) != coalesce(panel_materialized, false) then 1::double else 0::double end as score from js)"""

    @catalog.query(
        "integration_priority",
        f"""with fs as (select 'f' || c_custkey as field, c_custkey % 13 = 4 as blocked_or_metadata, case when c_custkey % 9 = 1 then null else c_custkey % 3 != 0 end as panel_materialized, c_custkey % 4 < 2 as factor_pack_referenced, c_custkey % 7 = 2 as selector_selected, {stated.format(k='c_custkey')} from customer), {integration}
        select field, integration_status, round(score, 6) as priority_score from ps""",
    )
    def integration_priority(spark, sf_dir):
        k = F.col("c_custkey")
        fields = table(spark, sf_dir, "customer").select(
            F.concat(F.lit("f"), k.cast("string")).alias("field"), (k % 13 == 4).alias("blocked_or_metadata"), F.when(k % 9 != 1, k % 3 != 0).alias("panel_materialized"), (k % 4 < 2).alias("factor_pack_referenced"), (k % 7 == 2).alias("selector_selected"), *_stated(k)
        )
        return led.integration_priority(fields).select("field", "integration_status", rnd(F.col("priority_score")).alias("priority_score"))

    panel = ["f2", "f4", "f9", "f12", "f15", "limit3"]

    @catalog.query(
        "integration_audit",
        f"""with a as (select case when s_suppkey % 6 = 0 then 'limit' || (s_suppkey % 5) else 'f' || (s_suppkey % 20) end as field, 'asset' || (s_suppkey % 3) as asset, s_suppkey % 17 = 3 as bm, {stated.format(k='s_suppkey')} from supplier), p as (select 'f' || (c_custkey % 25) as field from customer where c_mktsegment = 'BUILDING'),
        se as (select 'f' || (c_custkey % 11) as field from customer where c_mktsegment = 'MACHINERY' and c_nationkey < 3), fa as (select field, string_agg(distinct asset, '|' order by asset) as assets, bool_or(bm) as blocked_or_metadata, min(asset_status) as asset_status, min(source_registry) as source_registry, min(source_group) as source_group, min(field_family) as field_family, min(priority) as priority from a group by 1),
        fp as (select field, count(*) as pack_refs, true as factor_pack_referenced from p group by 1), fc as (select field, count(*) as selector_refs, true as selector_selected from se group by 1),
        fs as (select coalesce(fa.field, fp.field, fc.field) as field, assets, pack_refs, selector_refs, blocked_or_metadata, factor_pack_referenced, selector_selected, list_contains({_quoted(panel)}, coalesce(fa.field, fp.field, fc.field)) as panel_materialized, asset_status, source_registry, source_group, field_family, priority
          from fa full join fp on fa.field = fp.field full join fc on coalesce(fa.field, fp.field) = fc.field), {integration}
        select field, assets, pack_refs, selector_refs, integration_status, round(score, 6) as priority_score from ps""",
    )
    def integration_audit(spark, sf_dir):
        sup, cus = F.col("s_suppkey"), F.col("c_custkey")
        text = lambda start, n: F.concat(F.lit(start), n.cast("string"))
        assets = table(spark, sf_dir, "supplier").select(F.when(sup % 6 == 0, text("limit", sup % 5)).otherwise(text("f", sup % 20)).alias("field"), text("asset", sup % 3).alias("asset"), (sup % 17 == 3).alias("blocked_or_metadata"), *_stated(sup))
        customers = table(spark, sf_dir, "customer")
        packs = customers.where("c_mktsegment = 'BUILDING'").select(text("f", cus % 25).alias("field"))
        chosen = customers.where("c_mktsegment = 'MACHINERY' and c_nationkey < 3").select(text("f", cus % 11).alias("field"))
        out = led.integration_audit(assets, packs, chosen, panel)
        return out.select("field", "assets", "pack_refs", "selector_refs", "integration_status", rnd(F.col("priority_score")).alias("priority_score"))

    memory = "me as (select c_custkey as candidate_id, 'k' || (c_custkey % 90) as expression_key, 'rule' || (c_custkey % 6) as rule, c_custkey % 4 = 1 as retained, round(c_acctbal / 10000, 6) as reward, case c_custkey % 3 when 0 then 'stock' when 1 then 'sector' end as dataset_role from customer)"

    def _memory(spark, sf_dir):
        k = F.col("c_custkey")
        text = lambda start, n: F.concat(F.lit(start), (k % n).cast("string"))
        return table(spark, sf_dir, "customer").select(
            k.alias("candidate_id"), text("k", 90).alias("expression_key"), text("rule", 6).alias("rule"), (k % 4 == 1).alias("retained"), rnd(F.col("c_acctbal") / 10000).alias("reward"), F.when(k % 3 == 0, "stock").when(k % 3 == 1, "sector").alias("dataset_role")
        )

    @catalog.query("memory_stats", f"with {memory} select rule, count(*) as records, round(avg(case when retained then 1.0 else 0.0 end), 6) as retained_yield, round(avg(reward), 6) as mean_reward from me group by 1")
    def memory_stats(spark, sf_dir):
        return led.memory_stats(_memory(spark, sf_dir)).withColumns({"retained_yield": rnd(F.col("retained_yield")), "mean_reward": rnd(F.col("mean_reward"))})

    @catalog.query("memory_role_filter", f"with {memory} select candidate_id, case when dataset_role is not distinct from 'stock' then 'kept' else 'quarantined' end as memory_state from me")
    def memory_role_filter(spark, sf_dir):
        return led.memory_of_role(_memory(spark, sf_dir), "stock").select("candidate_id", "memory_state")

    @catalog.query(
        "memory_enrich",
        f"""with {memory}, rp as (select s_suppkey * 11 as candidate_id, 'k' || (s_suppkey % 40) as expression_key, round(s_acctbal / 1000, 6) as replay_reward from supplier), bk as (select expression_key, max(replay_reward) as b from rp group by 1)
        select m.candidate_id, coalesce(r.replay_reward, b.b) as replay_reward, case when r.replay_reward is not null then 'candidate_id' when b.b is not null then 'expression_key' end as matched_by from me m left join rp r on m.candidate_id = r.candidate_id left join bk b on m.expression_key = b.expression_key""",
    )
    def memory_enrich(spark, sf_dir):
        k = F.col("s_suppkey")
        replays = table(spark, sf_dir, "supplier").select((k * 11).alias("candidate_id"), F.concat(F.lit("k"), (k % 40).cast("string")).alias("expression_key"), rnd(F.col("s_acctbal") / 1000).alias("replay_reward"))
        return led.enrich_memory(_memory(spark, sf_dir), replays).select("candidate_id", "replay_reward", "matched_by")

    worths = [*led.DECISION_WORTH, "SOMETHING_ELSE"]

    @catalog.query(
        "replay_reward",
        f"""with x as (select c_custkey as position, (array{worths})[c_custkey % 6 + 1] as dc, case when c_custkey % 10 = 1 then null else c_acctbal / 900000 end as lr, case when c_custkey % 12 = 1 then null else c_acctbal / 2500 end as ls, case when c_custkey % 13 = 5 then null else c_acctbal / 300000 end as ic, c_custkey % 3 = 0 as tr, c_custkey % 5 as fl from customer)
        select position, round({" ".join(["case dc", *[f"when '{k}' then {v}::double" for k, v in led.DECISION_WORTH.items()], "else -0.02::double end"])} + greatest(-0.18::double, least(0.18::double, coalesce(lr, 0) * 40)) + greatest(-0.16::double, least(0.24::double, coalesce(ls, 0) * 0.08::double)) + greatest(-0.08::double, least(0.08::double, coalesce(ic, 0) * 4))
          + case when tr then 0.02::double else -0.03::double end - least(0.12::double, 0.04::double * fl), 6) as reward from x""",
    )
    def replay_reward(spark, sf_dir):
        k, bal = F.col("c_custkey"), F.col("c_acctbal").cast("double")
        r = table(spark, sf_dir, "customer").select(
            k.alias("position"),
            F.element_at(F.array(*map(F.lit, worths)), (k % 6 + 1).cast("int")).alias("auto_long_only_decision"),
            F.when(k % 10 != 1, bal / 900000).alias("mean_window_long_return"),
            F.when(k % 12 != 1, bal / 2500).alias("mean_window_long_sortino"),
            F.when(k % 13 != 5, bal / 300000).alias("mean_window_rank_ic"),
            (k % 3 == 0).alias("tradability_filter_available"),
            F.array_repeat(F.lit("flag"), (k % 5).cast("int")).alias("smoke_flags"),
        )
        return r.select("position", rnd(led.replay_reward()).alias("reward"))

    @catalog.query(
        "candidate_reward",
        """with x as (select c_custkey as position, c_custkey % 2 = 0 as rt, c_custkey % 3 = 0 as nv, c_custkey % 5 = 0 as fu, c_acctbal / 100000 as ic, (c_custkey % 90) / 100.0::double as st, (c_custkey % 70) / 70.0::double as cv, case when c_custkey % 4 = 1 then null else (c_custkey % 40) / 100.0::double end as fb, c_custkey % 900 as ch, c_custkey % 30 as oc from customer)
        select position, round(case when rt then 0.2::double else -0.1::double end + case when nv then 0.08::double else -0.03::double end + case when fu then 0.06::double else 0 end + 0.32::double * ic + 0.2::double * st + 0.14::double * cv + least(0.18::double, coalesce(fb, 0)) - least(0.35::double, ch / 4000.0::double + oc / 800.0::double), 6) as reward from x""",
    )
    def candidate_reward(spark, sf_dir):
        k = F.col("c_custkey")
        r = table(spark, sf_dir, "customer").select(
            k.alias("position"), (k % 2 == 0).alias("retained"), (k % 3 == 0).alias("novel_structure"), (k % 5 == 0).alias("full_evaluation_reached"), (F.col("c_acctbal") / 100000).alias("ic_max"), ((k % 90) / 100.0).alias("oos_stability"), ((k % 70) / 70.0).alias("ic_positive_coverage"),
            F.when(k % 4 != 1, (k % 40) / 100.0).alias("real_replay_feedback_score"), (k % 900).alias("char_count"), (k % 30).alias("operator_count"),
        )
        return r.select("position", rnd(led.candidate_reward()).alias("reward"))

    @catalog.query(
        "smoke_flags",
        """with w as (select 'c' || (c_custkey % 60) as candidate, 1990 + c_custkey // 60 as "window", case when c_custkey % 17 = 2 or c_custkey % 60 in (7, 8) and (c_custkey % 60 = 7 or c_custkey > 200) then null else (c_acctbal - 3500) / 90000 end as mean_rank_ic from customer where c_custkey % 60 != 9 or c_custkey < 200),
        r as (select *, case when row_number() over (partition by candidate order by "window" desc) <= 4 then mean_rank_ic end as rc from w),
        a as (select candidate, count(*) as windows, avg(mean_rank_ic) as mi, avg(rc) as ri, avg(case when rc is not null then case when rc > 0 then 1.0 else 0.0 end end) as pr from r group by 1)
        select candidate, windows, round(mi, 6) as mean_ic, round(ri, 6) as recent_ic, round(pr, 6) as recent_positive_ratio, concat_ws('|', case when mi is null then 'no_valid_quarterly_rank_ic' when mi < 0.01 then 'weak_mean_rank_ic_below_0_01' end, case when ri is null then 'no_recent_quarterly_rank_ic' when ri <= 0 then 'non_positive_recent_mean_rank_ic' end,
          case when pr < 0.5 then 'recent_positive_quarter_ratio_below_0_5' end, case when windows < 4 then 'insufficient_quarterly_windows' end) as flags,
        case when mi is null then 'reject_no_valid_recent_ic' when mi >= 0.01 then 'needs_full_history_review' when mi > 0 then 'watchlist_weak_positive_recent_ic' else 'reject_non_positive_recent_ic' end as decision from a""",
    )
    def smoke_flags(spark, sf_dir):
        k = F.col("c_custkey")
        silent = (k % 17 == 2) | (k % 60 == 7) | ((k % 60 == 8) & (k > 200))
        windows = table(spark, sf_dir, "customer").where("c_custkey % 60 != 9 or c_custkey < 200").select(F.concat(F.lit("c"), (k % 60).cast("string")).alias("candidate"), (F.lit(1990) + F.floor(k / 60)).alias("window"), F.when(~silent, (F.col("c_acctbal") - 3500) / 90000).alias("mean_rank_ic"))
        out = led.smoke_flags(windows)
        return out.withColumns({c: rnd(F.col(c)) for c in ("mean_ic", "recent_ic", "recent_positive_ratio")})

    groups = [("limit", "limit"), ("context", "ctx_"), ("price", "close"), ("price", "open"), ("flow", "amount")]
    listed = ", ".join(f"('{a}', '{b}')" for a, b in groups)

    @catalog.query("watchlist_groups", f"with {FORMULAS}, x as (select distinct unnest(regexp_extract_all(expression, {FIELDS}, 1)) as field from fm), gr(g, p) as (values {listed}) select distinct g as \"group\", field from x, gr where contains(field, p)")
    def watchlist_groups(spark, sf_dir):
        fields = formulas(spark).select(F.explode(sorted_fields(F.col("expression"))).alias("field")).distinct().withColumn("haystack", F.col("field"))
        return led.watch_groups(fields, groups)

    family = {"streak": "_streak_ge_|_streak", "window_count": "_count_t|_in_t", "market_high_board": "high_board", "limit_open": "open", "limit_touch": "touch", "limit_break": "break|repair|rebound", "limit_flip": "flip", "limit_close": "limit"}
    family_sql = lambda c: "case " + " ".join(f"when regexp_matches({c}, '{p}') then '{n}'" for n, p in family.items()) + " else 'unknown' end"
    event_names = ["limit_up_streak_ge_3", "limit_up_close_count_t5", "market_high_board", "limit_up_open_event", "limit_down_touch_event", "limit_up_break", "limit_down_repair", "limit_flip_up_to_down", "limit_up_event", "whatever", "limit_up_any_open_not_close_in_t4"]
    listed_events = ", ".join(f"('{n}')" for n in event_names)

    @catalog.query("event_spec", f"with v(f) as (values {listed_events}) select f as field, {family_sql('f')} as family from v")
    def event_spec(spark, sf_dir):
        return spark.createDataFrame([(n,) for n in event_names], "field string").select("field", led.event_family(F.col("field")).alias("family"))

    @catalog.query(
        "event_metadata",
        f"""with {FORMULAS}, x as (select expression, unnest(list_distinct(regexp_extract_all(expression, {FIELDS}, 1))) as f from fm), y as (select *, {family_sql("f")} as family, case when contains(f, 'open') then 'open_print' else 'after_close' end as clock from x where contains(f, 'limit') or contains(f, 'board'))
        select expression, string_agg(distinct family, '|' order by family) as families, string_agg(distinct clock, '|' order by clock) as clocks, count(*) as event_fields from y group by 1""",
    )
    def event_metadata(spark, sf_dir):
        f = formulas(spark).select("expression", sorted_fields(F.col("expression")).alias("fields"))
        names = f.select(F.explode("fields").alias("field")).distinct().where("contains(field, 'limit') or contains(field, 'board')")
        specs = names.select("field", led.event_family(F.col("field")).alias("family"), F.when(F.contains("field", F.lit("open")), "open_print").otherwise("after_close").alias("clock"))
        return led.event_metadata(f, specs)

    vec = "pv as (select s_suppkey as k, 'f' || s_suppkey as field, [(s_suppkey % 3)::double, (s_suppkey % 5)::double, (s_suppkey % 2)::double, 1.0::double, (s_suppkey % 7)::double] as v from supplier where s_suppkey < 60)"

    #: The same over the whole table.
    vec_whole = vec.replace(" where s_suppkey < 60", "")

    def _profiles(spark, sf_dir, some="s_suppkey < 60"):
        k = F.col("s_suppkey")
        vector = F.array(*[(k % n).cast("double") for n in (3, 5, 2)], F.lit(1.0), (k % 7).cast("double"))
        return table(spark, sf_dir, "supplier").where(some).select(F.concat(F.lit("f"), k.cast("string")).alias("field"), vector.alias("vector"))

    @catalog.query("field_redundancy", f"with {vec}, c as (select a.field as left_field, b.field as right_field, list_cosine_similarity(a.v, b.v) as cosine from pv a join pv b on a.field < b.field) select left_field, right_field, round(cosine, 6) as cosine from c where cosine >= 0.92 - 1e-12")
    def field_redundancy(spark, sf_dir):
        return led.redundant_fields(_profiles(spark, sf_dir), 0.92 - 1e-12)

    @catalog.query("field_redundancy_whole", f"with {vec_whole}, c as (select a.field as left_field, b.field as right_field, list_cosine_similarity(a.v, b.v) as cosine from pv a join pv b on a.field < b.field) select left_field, right_field, round(cosine, 6) as cosine from c where cosine >= 0.92 - 1e-12")
    def field_redundancy_whole(spark, sf_dir):
        return led.redundant_fields(_profiles(spark, sf_dir, "true"), 0.92 - 1e-12)

    def _mean_profiles(p):
        number = F.substring("field", 2, 9).cast("int")
        f = p.groupBy(F.concat(F.lit("e"), (number % 8).cast("string")).alias("expression")).agg(F.collect_set("field").alias("fields"))
        return led.expression_profile(f, p).withColumn("value", rnd(F.col("value")))

    @catalog.query(
        "expr_profile",
        f"""with {vec}, ex as (select 'e' || (k % 8) as expression, v from pv), d as (select expression, unnest(v) as x, generate_subscripts(v, 1) - 1 as dim from ex) select expression, cast(dim as integer) as dim, round(avg(x), 6) as value from d group by 1, 2""",
    )
    def expr_profile(spark, sf_dir):
        return _mean_profiles(_profiles(spark, sf_dir))

    @catalog.query(
        "expr_profile_whole",
        f"""with {vec_whole}, ex as (select 'e' || (k % 8) as expression, v from pv), d as (select expression, unnest(v) as x, generate_subscripts(v, 1) - 1 as dim from ex) select expression, cast(dim as integer) as dim, round(avg(x), 6) as value from d group by 1, 2""",
    )
    def expr_profile_whole(spark, sf_dir):
        return _mean_profiles(_profiles(spark, sf_dir, "true"))

    tag_sql = lambda text, words, none: f"coalesce(nullif(concat_ws('+', " + ", ".join(f"case when regexp_matches({text}, '{p}') then '{n}' end" for n, p in words.items()) + f"), ''), '{none}')"
    primitive_sql = "concat_ws('+', " + ", ".join(f"case when list_has_any(names, {list(group)}) then '{n}' end" for n, group in led.PRIMITIVE_FAMILIES.items()) + ")"

    @catalog.query(
        "candidate_schema",
        f"""with {RESULTS}, a as (select position, expression, expression_hash, lane, horizon, mean_one_way_turnover as t, array_to_string(list_sort(list_distinct(regexp_extract_all(expression, {FIELDS}, 1))), '|') as fields, list_transform(regexp_extract_all(expression, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1), lambda n: lower(n)) as names from rs),
        b as (select *, {tag_sql("lower(fields) || '|' || lane", led.FIELD_FAMILIES, "generic_price_volume")} as field_family, {tag_sql("lower(expression) || '|' || lower(fields) || '|' || lane", led.EVENT_FAMILIES, "none")} as event_state_family,
          case when len(names) = 0 then 'raw_field' when {primitive_sql} = '' then array_to_string(list_sort(list_distinct(names[1:4])), '+') else {primitive_sql} end as primitive_family,
          case when horizon <= 5 then 'h1_5' else 'h5_15' end as horizon_bucket, case when t < 0.35 then 'low_turnover' when t < 0.65 then 'medium_turnover' when t < 0.85 then 'high_turnover' else 'extreme_turnover' end as turnover_bucket, substr(sha256(array_to_string(names[1:6], '|') || '|' || fields), 1, 12) as subtree_hashes from a)
        select substr(expression_hash, 1, 12) as candidate_id, expression, 'unknown_arm' as generator_arm, field_family, primitive_family, event_state_family, horizon_bucket, turnover_bucket, subtree_hashes,
          substr(sha256(concat_ws('|', field_family, primitive_family, event_state_family, horizon_bucket, turnover_bucket, subtree_hashes)), 1, 18) as family_id, substr(sha256(concat_ws('|', field_family, primitive_family, event_state_family, subtree_hashes)), 1, 18) as motif_id, 'report_only' as validation_usage from b""",
    )
    def candidate_schema(spark, sf_dir):
        r = results(spark, sf_dir).withColumnsRenamed({"lane": "factor_lane", "horizon": "horizon_min"}).withColumn("fields", F.array_join(sorted_fields(F.col("expression")), "|"))
        return led.candidate_schema(r).select("candidate_id", "expression", "generator_arm", "field_family", "primitive_family", "event_state_family", "horizon_bucket", "turnover_bucket", "subtree_hashes", "family_id", "motif_id", "validation_usage")

    @catalog.query("registry_routes", f"with {FORMULAS}, x as (select distinct unnest(regexp_extract_all(expression, {FIELDS}, 1)) as field from fm) select field, case when contains(field, 'limit') or contains(field, 'seal') then 'typed_event' when starts_with(field, 'ctx_') or starts_with(field, 'fund_') then 'coverage_guard' when regexp_matches(field, 'code|time|label|next_') then 'blocked' else 'ordinary' end as route from x")
    def registry_routes(spark, sf_dir):
        f = formulas(spark).select(F.explode(sorted_fields(F.col("expression"))).alias("field")).distinct()
        c = F.col("field")
        has = lambda w: F.contains(c, F.lit(w))
        route = F.when(has("limit") | has("seal"), "typed_event").when(c.startswith("ctx_") | c.startswith("fund_"), "coverage_guard").when(c.rlike("code|time|label|next_"), "blocked").otherwise("ordinary")
        return f.select("field", route.alias("route"))

    aliases = [("limits", "limit"), ("limits", "limit_up"), ("price", "close"), ("turnover", "turnover_ratio"), ("context", "ctx"), ("strong", "zls_strong")]
    listed_aliases = ", ".join(f"('{a}', '{b}')" for a, b in aliases)
    norm = lambda c: f"'|' || array_to_string(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w != ''), '|') || '|'"

    @catalog.query(
        "alias_match",
        f"""with {FORMULAS}, x as (select distinct unnest(regexp_extract_all(expression, {FIELDS}, 1)) as field from fm), al(asset, alias) as (values {listed_aliases}),
        m as (select field, asset, alias, case when lower(field) = alias then 'equal' when contains({norm("field")}, {norm("alias")}) then case when contains(alias, '_') then 'sequence' else 'token' end end as how from x, al) select * from m where how is not null""",
    )
    def alias_match(spark, sf_dir):
        fields = formulas(spark).select(F.explode(sorted_fields(F.col("expression"))).alias("field")).distinct()
        return led.match_aliases(fields, aliases)

    @catalog.query(
        "pool_enrich",
        """with p as (select 'h' || c_custkey as expression_hash, c_mktsegment as bucket, round(c_acctbal, 2) as quality from customer where c_custkey % 10 = 0), ad as (select 'h' || c_custkey as expression_hash, c_mktsegment as bucket, round(c_acctbal, 2) as quality from customer where c_custkey % 2 = 0),
        me as (select 'h' || s_suppkey * 4 as expression_hash from supplier), n as (select * from ad where expression_hash not in (select expression_hash from p) and expression_hash not in (select expression_hash from me)),
        r as (select *, row_number() over (partition by bucket order by quality desc, expression_hash) as i from n) select expression_hash, bucket, quality from p union all select expression_hash, bucket, quality from r where i <= case bucket when 'BUILDING' then 5 when 'MACHINERY' then 9 else 12 end""",
    )
    def pool_enrich(spark, sf_dir):
        c = table(spark, sf_dir, "customer")
        rows = c.select("c_custkey", F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("expression_hash"), F.col("c_mktsegment").alias("bucket"), rnd(F.col("c_acctbal"), 2).alias("quality"))
        memory = table(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), (F.col("s_suppkey") * 4).cast("string")).alias("expression_hash"))
        return led.enrich_pool(rows.where("c_custkey % 10 = 0").drop("c_custkey"), rows.where("c_custkey % 2 = 0").drop("c_custkey"), memory, {"BUILDING": 5, "MACHINERY": 9}, 12)

    @catalog.query("gen_templates")
    def gen_templates(spark, sf_dir):
        return typed_gate(s.templates(spark, AVAILABLE)).select("expression", "lane", "note", "typed_gate_decision")

    @catalog.query("lifecycle_audit")
    def lifecycle_audit(spark, sf_dir):
        own = load().queries
        found = led.lifecycle_audit(own["field_coverage"](spark, sf_dir), own["field_usage"](spark, sf_dir), ["gappy", "trade_time"], 2, ["event_state", "lagged_context", "direct_formula"])
        return spark.createDataFrame([("|".join(found["blockers"]), found["decision"])], "blockers string, decision string")

    @catalog.query("bx_audit")
    def bx_audit(spark, sf_dir):
        r = results(spark, sf_dir)
        by = ["expression_hash"]
        cells = r.select(*by, F.concat_ws("-", "position", "horizon").alias("cell"), F.col("aligned_spread_mean").alias("spread"), F.col("aligned_ic_mean").alias("ic"))
        tops = r.groupBy(*by).agg(F.avg("aligned_ic_mean").alias("aligned_ic_mean"), F.avg("mean_one_way_turnover").alias("mean_one_way_turnover"), F.min("blocker_flags").alias("blocker_flags"))
        return led.proxy_audit(tops, cells, by, iterations=2000)

    @catalog.query("bucket_budgets")
    def bucket_budgets(spark, sf_dir):
        asked = [(n, e, r, f) for n in (1, 7, 64, 257) for e, r, f in ((0.3, 0.2, 0.1), (0.9, 0.9, 0.9), (0.0, 0.0, 0.0), (0.45, 0.35, 0.25))]
        return spark.createDataFrame([(*row, k, v) for row in asked for k, v in led.bucket_budgets(*row).items()], "total int, event double, research double, fundamental double, bucket string, budget int")

    @catalog.query("incremental_checkpoint", "select s_suppkey, s_acctbal from supplier")
    def incremental_checkpoint(spark, sf_dir):
        import uuid

        path = f"{shared_folder(spark)}/reward-{uuid.uuid4().hex}"
        rows = table(spark, sf_dir, "supplier")
        batch = lambda test: rows.where(test).select("s_suppkey", "s_acctbal")
        # Batches that overlap, and together have every row.
        led.append_checkpoint(batch("s_nationkey < 15"), path, ["s_suppkey"])
        return led.append_checkpoint(batch("s_nationkey >= 10 or s_nationkey is null"), path, ["s_suppkey"])
