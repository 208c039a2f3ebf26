"""Budgets, splits, curves and picks against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import feedback as fb
from spindrift.operators import metrics as m
from spindrift.operators.selection import pick_capped


@pytest.mark.parametrize("total", [1, 7, 64, 512])
def test_budgets_sum_up(total):
    rng = random.Random(total)
    for _ in range(30):
        feedback = {a.name: {"median_train_reward": rng.uniform(-1, 1), "clean_feedback_count": rng.randrange(40), "feedback_update_allowed": rng.random() < 0.5, "hack_rate": rng.random() / 3, "lag_rate": rng.random() / 3, "exploit_allowed_family_count": rng.randrange(3)} for a in fb.ARMS if rng.random() < 0.7}
        rows = fb.schedule_arms(feedback, exploit_families=rng.randrange(2), total=total)
        assert sum(r["candidate_budget"] for r in rows) == total and all(r["candidate_budget"] >= 0 for r in rows)


def test_exploitation_is_capped_until_feedback_is_clean():
    rows = {r["arm_id"]: r for r in fb.schedule_arms({}, exploit_families=0, total=1000)}
    assert rows["cem_exploit"]["scheduler_action"] == "probe_only" and rows["cem_exploit"]["candidate_budget"] <= 61
    assert sum(r["candidate_budget"] for r in rows.values() if r["category"] == "fresh") >= 449
    rows = {r["arm_id"]: r for r in fb.schedule_arms({"cem_exploit": {"feedback_update_allowed": True, "clean_feedback_count": 40, "median_train_reward": 0.4}}, exploit_families=2, total=1000)}
    assert rows["cem_exploit"]["scheduler_action"] == "guarded_exploit"


def test_scaled_budgets():
    for total in (3, 10, 97):
        out = fb.scale_budgets({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, total)
        assert sum(out.values()) == total and out["d"] == 0 and min(out[k] for k in "abc") >= 1


def test_caps_depend_on_order():
    rows = [{"lane": a, "fields": b, "k": k} for k, (a, b) in enumerate([("x", 1), ("x", 2), ("x", 3), ("y", 1), ("y", 1), ("z", 9)])]
    assert [r["k"] for r in pick_capped(rows, 10, {"lane": 2, "fields": 2})] == [0, 1, 3, 5]
    assert [r["k"] for r in pick_capped(rows, 2, {"lane": 2, "fields": 2})] == [0, 1]


def test_two_sortinos_and_drawdown(spark):
    from spindrift.functions.numeric import sortino_of_negatives, sortino_of_shortfall

    curves = {"up": [0.1, 0.2, 0.05], "mixed": [0.1, -0.2, 0.05, -0.1], "one": [0.1, -0.2], "none": [None], "flat": [0.0, 0.0]}
    rows = [(c, k, v) for c, values in curves.items() for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "c string, t int, net_return double")
    got = {r.c: r for r in frame.groupBy("c").agg(sortino_of_negatives(F.col("net_return")).alias("a"), sortino_of_shortfall(F.col("net_return")).alias("b")).collect()}
    fall = {r.c: r.max_drawdown for r in m.max_drawdown(frame, ["c"], "t").collect()}
    assert got["up"].a == pytest.approx(0.116667) and got["up"].b is None and got["one"].a is None and got["none"].a is None
    values = curves["mixed"]
    mean = sum(values) / 4
    assert got["mixed"].a == pytest.approx(round(mean / 0.05 * 2, 6)) and got["mixed"].b == pytest.approx(mean / math.sqrt((0.04 + 0.01) / 4))
    assert fall["up"] == 0 and fall["one"] == pytest.approx(-0.2) and fall["mixed"] == pytest.approx(0.8 * 1.05 * 0.9 - 1)


def test_bootstrap_is_seeded(spark):
    days = spark.createDataFrame([("a", k, 0.01 * (k % 5 - 1.5)) for k in range(20)], "candidate string, date int, day_return double")
    one, two = (m.day_bootstrap(days, ["candidate"], 100).collect() for _ in range(2))
    assert one == two and one[0].iterations == 100 and one[0].p05 <= one[0].median <= one[0].p95


def test_split_rounds_half_to_even(spark):
    times = spark.createDataFrame([(0, k) for k in range(5)] + [(1, 0)], "shard int, t int")
    out = {(r.shard, r.t): r.split for r in m.chronological_split(times, ["shard"], "t", 0.5, 0.3).collect()}
    assert [out[0, k] for k in range(5)] == ["train", "train", "validation", "validation", "holdout"] and out[1, 0] == "train"


def test_policy_keeps_still_with_too_few(spark):
    policy = spark.createDataFrame([("field", "close", 0.2)], "kind string, key string, score double")
    schema = "expression string, lane string, blocker_flags string, mean_one_way_turnover double, abs_aligned_ic_mean double, positive_horizon_count double"
    decision = spark.createDataFrame([("CSRank($close)", "l", "", 0.3, 0.1, 2.0)], schema)
    assert fb.policy_feedback(policy, decision, least=2).collect() == policy.collect()
    moved = {(r.kind, r.key): r.score for r in fb.policy_feedback(policy, decision, least=1).collect()}
    credit = 0.75 * 0.1 + 0.05 + 0.04
    assert moved["field", "close"] == pytest.approx(0.45 * 0.2 + 0.55 * credit) and all(0.015 <= v <= 1.25 for v in moved.values())
    lagged = decision.withColumn("blocker_flags", F.lit(fb.WRONG_LAG))
    assert fb.policy_feedback(policy, lagged, least=1).collect() == policy.collect()


def test_stream_bars(spark, tmp_path):
    from spindrift.streaming import stream_bars

    spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,cast(id as int)*20) as ts, id as user_id, 'purchase' as event_type, cast(id as double) as value from range(50)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = stream_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(volume) v from bars").first().v == 50


def test_checkpoint_can_be_repeated(spark, tmp_path):
    from spindrift.operators.ledgers import append_checkpoint

    batch = spark.range(5).selectExpr("id as k", "id * 2 as v")
    for _ in range(2):
        out = append_checkpoint(batch, f"{tmp_path}/ck", ["k"])
    assert out.count() == 5


def test_small_gates():
    from spindrift.operators import ledgers as led

    assert sum(led.bucket_budgets(101, 0.9, 0.2, 0.1).values()) == 101 and led.bucket_budgets(100, 0.9, 0.0, 0.0)["event"] == 60
    assert led.evidence_gate({"a": True, "b": False}, {"x": 1.0}, {"x": 0.5, "y": 0.0}) == {"ready": False, "missing": ["b"], "below": ["y"]}
    assert led.feedback_allowed(40, 32, None, 1, True) == (True, "") and not led.feedback_allowed(3, 32, None, 1, False)[0]
    assert not led.feedback_allowed(40, 32, False, 1, False)[0] and not led.feedback_allowed(40, 32, None, 0, True)[0]
