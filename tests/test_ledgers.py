"""Rules of the ledgers on rows worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from spindrift.operators import ledgers as led
from spindrift.operators import metrics as m


def test_groups_to_watch_and_demote(spark):
    # lane a: one passed; b: none, mean 0.02; c: one row, none, mean -0.1; d: two rows, no value; e: two rows, -0.1 and 0.1.
    rows = [("a", True, 0.5), ("a", False, -0.5), ("b", False, 0.01), ("b", False, 0.03), ("c", False, -0.1), ("d", False, None), ("d", False, None), ("e", False, -0.1), ("e", False, 0.1)]
    ev = spark.createDataFrame([(lane, "", "cell", "", p, ic) for lane, p, ic in rows], "lane string, source string, cell string, fields string, passed boolean, mean_ic double")
    out = {(r.group, r.key): r for r in led.replay_objective(ev).collect()}
    assert {k: r.status for (g, k), r in out.items() if g == "lane"} == {"a": "neutral", "b": "watched", "c": "neutral", "d": "demoted", "e": "demoted"}
    assert out["source", "unknown"].evaluations == 9 and not any(g == "field" for g, _ in out)
    many = spark.createDataFrame([(f"w{k:02d}", "s", "c", "", False, 0.01 * k) for k in range(1, 12)] + [(f"x{k:02d}", "s", "c", "", False, -0.01 * k) for k in range(15) for _ in range(2)], ev.schema)
    found = led.replay_objective(many).collect()
    # Lists have lengths: the best 8, and the worst 12 over all kinds of groups. The cell of all rows has a mean of -1.44 / 41, between x03 and x04.
    assert sorted(r.key for r in found if r.status == "watched") == [f"w{k:02d}" for k in range(4, 12)]
    assert sorted((r.group, r.key) for r in found if r.status == "demoted") == [("cell", "c")] + [("lane", f"x{k:02d}") for k in range(4, 15)]


def test_round_score(spark):
    rows = [
        ("", 0.04, 0.5, 1.0, "l1", "CSRank($close)"),
        ("future_signal_wrong_lag_too_strong", 0.08, 0.5, 2.0, "l1", "CSRank($close)"),
        ("signal_corr_abs_ge_0.75", 0.02, 0.5, 2.0, "l2", "Mul($close,$open)"),
        ("", 0.06, 0.99, 2.0, "", ""),
    ]
    out = led.round_metrics(spark.createDataFrame([(f, ic, -ic, t, n, lane, x) for f, ic, t, n, lane, x in rows], "blocker_flags string, abs_aligned_ic_mean double, aligned_ic_mean double, mean_one_way_turnover double, positive_horizon_count double, lane string, expression string")).first()
    assert (out.candidates, out.hard_blocked, out.non_future, out.research_pool, out.lanes, out.fieldsets, out.shapes) == (4, 2, 3, 1, 2, 2, 2)
    assert math.isclose(out.top10_abs_ic_mean, 0.05) and math.isclose(out.best_abs_ic, 0.08)
    assert math.isclose(out.round_score, 0.45 / 4 + 0.20 * 3 / 4 + 0.15 * 2 / 18 + 0.12 * 2 / 30 + 0.08 * 2 / 24 + 0.08 * 0.05 / 0.08)


@pytest.mark.parametrize(
    ("row", "state", "score"),
    [
        ((True, True, True, True, "ready", "", "", "price_state", "high"), "blocked_or_metadata", 0 + 1.2 + 2.0),
        ((False, True, False, False, None, None, None, None, None), "integrated_selector_selected", 0.5),
        ((False, False, True, True, "blocked", "", "", "flow_liquidity", "LOW"), "integrated_selector_ready", 1.0 + 2.8 + 0.2),
        ((False, False, False, True, "backlog", "", "", "none such", ""), "panel_only", 5.0 + 1.0),
        ((None, None, True, None, "ready", "", "", "fundamental", "medium"), "factor_pack_only_missing_panel", 4.5 + 1.2 + 1.0 + 1.0),
        ((False, False, False, False, "ready", "Probe_x", "", "capacity_size", "very_high"), "probe_or_backlog", 2.0 + 2.6 + 3.0),
        ((False, False, False, False, "ready", "registry", "group", "limit_event_sentiment", ""), "contract_only", 3.0 + 3.0),
    ],
)
def test_integration_states(spark, row, state, score):
    schema = "blocked_or_metadata boolean, selector_selected boolean, factor_pack_referenced boolean, panel_materialized boolean, asset_status string, source_registry string, source_group string, field_family string, priority string"
    out = led.integration_priority(spark.createDataFrame([row], schema)).first()
    assert out.integration_status == state and math.isclose(out.priority_score, score)


def test_rewards(spark):
    replays = spark.createDataFrame(
        [("LONG_ONLY_REVIEW", 0.001, 1.5, 0.01, True, ["a"]), ("REJECT_NON_POSITIVE_LONG_RETURN", -1.0, -9.0, -1.0, False, list("abcdef")), (None, None, None, None, None, None)],
        "auto_long_only_decision string, mean_window_long_return double, mean_window_long_sortino double, mean_window_rank_ic double, tradability_filter_available boolean, smoke_flags array<string>",
    )
    got = [r[0] for r in replays.select(led.replay_reward()).collect()]
    assert [round(x, 6) for x in got] == [round(0.14 + 0.04 + 0.12 + 0.04 + 0.02 - 0.04, 6), round(-0.12 - 0.18 - 0.16 - 0.08 - 0.03 - 0.12, 6), -0.05]
    candidates = spark.createDataFrame([(True, False, True, 0.5, 0.4, 0.3, 0.9, 400, 8), (False, True, False, 0.0, 0.0, 0.0, None, 4000, 0)], "retained boolean, novel_structure boolean, full_evaluation_reached boolean, ic_max double, oos_stability double, ic_positive_coverage double, real_replay_feedback_score double, char_count int, operator_count int")
    got = [r[0] for r in candidates.select(led.candidate_reward()).collect()]
    assert [round(x, 6) for x in got] == [round(0.20 - 0.03 + 0.06 + 0.16 + 0.08 + 0.042 + 0.18 - 0.11, 6), round(-0.10 + 0.08 - 0.35, 6)]


def test_smoke_flags_of_recent_windows(spark):
    windows = [("old", k, 0.1) for k in range(4)] + [("old", k, -0.01) for k in range(4, 8)] + [("few", 1, 0.02), ("few", 2, 0.005)] + [("none", k, None) for k in range(5)] + [("late", k, 0.05) for k in range(4)] + [("late", k, None) for k in range(4, 8)]
    out = {r.candidate: r for r in led.smoke_flags(spark.createDataFrame(windows, "candidate string, window int, mean_rank_ic double")).collect()}
    assert (out["old"].flags, out["old"].decision) == ("non_positive_recent_mean_rank_ic|recent_positive_quarter_ratio_below_0_5", "needs_full_history_review")
    assert (out["few"].flags, out["few"].windows) == ("insufficient_quarterly_windows", 2)
    assert (out["none"].flags, out["none"].decision) == ("no_valid_quarterly_rank_ic|no_recent_quarterly_rank_ic", "reject_no_valid_recent_ic")
    assert out["late"].flags == "no_recent_quarterly_rank_ic" and out["late"].recent_positive_ratio is None


def test_bucket_budgets():
    assert led.bucket_budgets(100, 0.3, 0.2, 0.1) == {"event": 30, "research": 20, "fundamental": 10, "r0_cem_led": 17, "ast_failure_aware_repair": 8, "agnostic_freeform_ast": 8, "formula_gen_v2_repair_expansion": 5, "replay_aware_residual": 2}
    # Rounded apart the three are 4 + 2 + 2 of 7: research gives way.
    assert [led.bucket_budgets(7, 0.9, 0.9, 0.9)[k] for k in ("event", "research", "fundamental")] == [4, 1, 2]
    for total in range(1, 40):
        for shares in ((0, 0, 0), (0.33, 0.17, 0.08), (1, 1, 1), (0.6, -1, 0.25)):
            out = led.bucket_budgets(total, *shares)
            assert sum(out.values()) == total and min(out.values()) >= 0


def test_proxy_decisions(spark):
    cells = [(k, f"{k}{c}", s, 0.01) for k, spreads in {"good": [0.02, 0.01, 0.03, -0.001], "turned": [-0.02, -0.01, -0.03, 0.001], "weak": [0.01, -0.01, 0.012, -0.01], "held": [0.02, 0.01, 0.03, -0.001], "busy": [0.02, 0.01, 0.03, -0.001]}.items() for c, s in enumerate(spreads)]
    tops = [("good", 0.02, 0.5, ""), ("turned", -0.02, 0.5, None), ("weak", 0.02, 0.5, " "), ("held", 0.02, 0.5, "x"), ("busy", 0.02, 0.8, ""), ("absent", 0.02, 0.5, "")]
    out = {r.key: r for r in led.proxy_audit(spark.createDataFrame(tops, "key string, aligned_ic_mean double, mean_one_way_turnover double, blocker_flags string"), spark.createDataFrame(cells, "key string, cell string, spread double, ic double"), ["key"], 300).collect()}
    assert {k: r.decision for k, r in out.items()} == {"good": "REWARD_AUDIT_FOLLOWUP", "turned": "REWARD_AUDIT_FOLLOWUP", "weak": "HOLD_WEAK_MCMC", "held": "HOLD_BLOCKED", "busy": "HOLD_EXTREME_TURNOVER", "absent": "HOLD_WEAK_MCMC"}
    assert out["turned"].proxy_mean_spread == out["good"].proxy_mean_spread and out["turned"].proxy_mean_signed_ic == -0.01


def test_candidate_schema(spark):
    rows = [("Mul(CSRank($amount),Delta($up_limit_x,3))", "", "phase3bt_event", 0.9, 20.0, None), ("$close", "given", "", None, None, 0.5), (None, "", "", 0.35, 5.0, None)]
    out = led.candidate_schema(spark.createDataFrame(rows, "expression string, field_family string, run string, mean_one_way_turnover double, horizon_min double, train_reward double")).collect()
    assert len(out[0]) == 36
    a, b, c = out
    assert (a.field_family, a.primitive_family, a.event_state_family, a.horizon_bucket, a.turnover_bucket, a.generator_arm, a.generator_route) == ("flow_amount_volume+limit_event_state", "cross_sectional+time_series+arithmetic", "limit_up", "h15_30", "extreme_turnover", "typed_ast_fresh", "phase3bt-ast-algorithm-bakeoff")
    assert (b.field_family, b.primitive_family, b.horizon_bucket, b.turnover_bucket, b.optimizer_reward, b.optimizer_reward_split) == ("given", "raw_field", "multi_or_unknown", "turnover_unknown", "0.5", "train")
    assert (c.expression, c.turnover_bucket, c.horizon_bucket, c.optimizer_reward_source, c.generator_arm) == ("", "medium_turnover", "h1_5", "", "unknown_arm")
    assert len(a.family_id) == len(a.motif_id) == 18 and a.candidate_id == a.expression_hash[:12]


def test_pairwise_sums_against_the_aggregate(spark):
    x = F.col("id")
    wide = spark.range(0, 500, 1, 5).select((x % 7 / 7.0).alias("a"), F.when(x % 3 > 0, x % 11 / 11.0).alias("b"), F.lit(0.3).alias("c"), F.when(x < 3, x * 1.0).alias("d"), (-(x % 7) / 7.0).alias("e"))
    got = {(r.left, r.right): r.signal_rank_corr for r in m.pairwise_correlation(wide, list("abcde")).collect()}
    assert len(got) == 10
    for (left, right), value in got.items():
        expected = wide.agg(m.correlation(left, right)).first()[0]
        assert (value is None) == (expected is None) and (value is None or math.isclose(value, expected, abs_tol=1e-9))
    assert got["a", "c"] is None and got["a", "d"] is None and math.isclose(got["a", "e"], -1)


def test_reward_tables_are_found_and_merged(spark, tmp_path):
    for name, rows in {"a/phase3cm_train_reward.csv": "expression,train_reward\n\"Mul($a,$b)\",0.5\n$c,0.1\n", "b/c/phase3cm_candidate_train_reward_summary.csv": "expression,train_reward\n$c,0.9\n$d,\n", "b/other.csv": "x\n1\n"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(rows)
    named = f"{tmp_path}/a/phase3cm_train_reward.csv"
    found = led.find_reward_tables(spark, [named, f"{tmp_path}/none.csv"], [str(tmp_path), f"{tmp_path}/nowhere"])
    assert [p.rsplit("/", 1)[1] for p in found] == ["phase3cm_train_reward.csv", "phase3cm_candidate_train_reward_summary.csv"]
    rows = {r.expression: r.train_reward for r in led.read_reward_tables(spark, found).collect()}
    assert rows == {"Mul($a,$b)": "0.5", "$c": "0.1", "$d": ""}
    assert led.read_reward_tables(spark, []).collect() == []


def test_chunks_merge(spark):
    schema = "key string, train_reward string, train_reward_decision string"
    chunks = {2: spark.createDataFrame([("a", "0.5", "TRAIN_REWARD_FOLLOWUP_READY"), ("b", "", "HOLD")], schema), 1: spark.createDataFrame([("c", "0.7", "HOLD", 1)], schema + ", extra int")}
    rows, counts = led.merge_chunks(chunks)
    assert [(r.key, r.parallel_chunk_id, r.extra) for r in rows.collect()] == [("c", 1, 1), ("a", 2, None), ("b", 2, None)]
    assert counts == {"candidate_count": 3, "followup_count": 1, "parallel_chunk_count": 2}


def test_year_folders(spark, tmp_path):
    from spindrift.sources.panels import read_years

    spark.createDataFrame([(k, 2000 + k % 3) for k in range(9)], "code int, year int").write.partitionBy("year").parquet(f"{tmp_path}/ctx")
    assert sorted(r.code for r in read_years(spark, f"{tmp_path}/ctx", [2001, 2002, 2009], "code int").collect()) == [1, 2, 4, 5, 7, 8]
    assert read_years(spark, f"{tmp_path}/ctx", [1990], "code int").collect() == []
    assert read_years(spark, f"{tmp_path}/nowhere", [2001], "code int").collect() == []


def test_capped_walk_goes_on():
    """Caps that only the last of very many proposals meets."""
    from spindrift.operators.selection import pick_capped

    rows = ({"position": k, "lane": "x" if k < 5000 else "y", "fields": f"f{k}"} for k in range(5001))
    assert [r["position"] for r in pick_capped(rows, 3, {"lane": 2, "fields": 1})] == [0, 1, 5000]
