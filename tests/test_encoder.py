"""The field encoder on names worked out by hand, and rounds that report their progress."""

import math

from spindrift.operators import encoder as e
from spindrift.operators import ledgers as led
from spindrift.operators import search as s


def test_names_and_edges(spark):
    names = ["CLOSE", "$$low", "pldn", "ma2", "close_ma_2", "ma5_mean_3", "_ma_5", "close_x_ma_5", "ma_", "", None, "fund_", "limit_up_streak_ge_10", "limit_up_streak_ge_0", "xlimit_up_break", "CLOSE"]
    x = e.encode_fields(spark.createDataFrame([(n, k) for k, n in enumerate(names)], "field string, traits_of long"))
    out = {r.traits_of: r for r in x.collect()}
    assert len(out) == len(names) and "traits_of" in x.columns
    assert [out[k].canonical_name for k in range(len(names))] == ["close", "low", "low", "close_mean_2", "close_mean_2", "ma5_mean_3", None, None, None, None, None, "fund_", "limit_up_streak_ge_10", None, None, "close"]
    assert out[10].field_name == "close" and out[10].vector == [0.7, 0.1, 0.2, 0.25, 0.05, 1.0, 0.0, 0.0]
    # Derived of derived: the close, and twice a mean (turnover ends at 0).
    assert out[5].field_type == "derived_derived_price_ts" and out[5].vector == [0.9, 0.1, 0.3, 0.05, 0.0, 1.0, 0.0, 0.0]
    assert e.encode_fields(spark.createDataFrame([], "field string")).count() == 0


def test_formulas_count_repeats_and_look_through_derived_fields(spark):
    x = spark.createDataFrame([("Add($close,Sub($close,$low))",), ("Mom($volume_ma_20,5)",), ("1",), ("1",), (None,)], "expression string")
    out = {r.expression: r for r in e.formula_traits(x).collect()}
    assert len(out) == 4 and math.isclose(out["Add($close,Sub($close,$low))"].momentum, round((0.7 + 0.7 + 0.2) / 3, 6))
    assert out["Mom($volume_ma_20,5)"].turnover == 0.85 and out["1"].momentum == out[None].momentum == 0.7


def test_redundant_pairs_of_the_first_batch(spark):
    x = e.encode_fields(spark.createDataFrame([(n,) for n in e.FIRST_BATCH], "field string")).collect()
    cosine = lambda a, b: sum(p * q for p, q in zip(a, b)) / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b))
    expected = {(a.field, b.field) for a in x for b in x if a.field < b.field and cosine(a.vector, b.vector) >= 0.92}
    pairs = led.redundant_fields(spark.createDataFrame(x).select("field", "vector"))
    assert {(r.left_field, r.right_field) for r in pairs.collect()} == expected and expected
    report = e.redundancy_report(pairs, len(e.FIRST_BATCH)).first()
    assert report.redundant_pairs == len(expected) and report.redundancy_pass == (len(expected) / 28 < 0.6)
    assert e.redundancy_report(pairs.limit(0), 1).first().redundancy_ratio == 0.0


def test_progress_is_told_and_its_failures_change_nothing(spark):
    heard = []

    def callback(event):
        heard.append((event["event"], event["round"]))
        raise ValueError("no one listens")

    policy = spark.createDataFrame([("lane", "nothing", 0.0)], "kind string, key string, score double")
    memory = spark.createDataFrame([("nothing",)], "expression_hash string")
    run = lambda progress: s.adaptive_rounds(spark, [], policy, memory, None, ["rx_ucb", "rx_ucb"], 4, progress=progress)
    assert run(callback) == run(None) and heard == [("round_start", 1), ("round_end", 1), ("round_start", 2), ("round_end", 2)]
