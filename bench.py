"""Times the headline workloads and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.catalog import metrics as catalog_metrics
from spindrift.catalog.joins import _facts, _market, _once
from spindrift.catalog.search import measure
from spindrift.operators import joins as j
from spindrift.operators import metrics as m
from spindrift.plans.compiler import evaluate
from spindrift.session import build_session
from spindrift.sources.panels import daily_panel, minute_panel

#: One formula with twenty operators.
WIDE_FORMULA = (
    "CSRank(Sub(ZScore(Add(Delta($volume,3),Mul(Mean($close,5),Sign(Sub($close,$open))))),"
    "Add(CSRank(Div(Std($close,6),Mean($amount,8))),Sub(Abs(Mom($close,4)),Neg(CSResidual(Corr($close,$volume,10),Log($amount)))))))"
)


CANDIDATE_HORIZONS = (1, 5, 15, 30)


def batch_formulas(n: int = 32) -> list[str]:
    """A batch of different formulas that share parts, as a search makes them."""
    fields = ["close", "volume", "amount", "high"]
    made = []
    for k in range(n):
        a, b, w = fields[k % 4], fields[(k // 4 + 1) % 4], 2 + k % 6
        made.append([f"CSRank(ZScore(Delta(${a},{w})))", f"CSRank(Sub(ZScore(${a}),Mean(ZScore(${b}),{w})))", f"CSRank(Corr(${a},${b},{w + 6}))", f"Neg(CSRank(Std(${a},{w + 1})))"][k // 8 % 4])
    return list(dict.fromkeys(made))


def operators_20(spark, d) -> DataFrame:
    return evaluate(daily_panel(spark, d), {"signal": WIDE_FORMULA})


def candidates_32(spark, d) -> DataFrame:
    """A batch of candidates with all their metrics, shard by shard at four horizons, and how alike they are."""
    rows = [{"expression_hash": f"h{k}", "expression": t} for k, t in enumerate(batch_formulas())]
    metrics, alike = measure(minute_panel(spark, d).cache(), CANDIDATE_HORIZONS, "shard_index")(rows)
    return metrics.join(alike.groupBy(F.col("left").alias("expression_hash")).agg(F.max(F.abs("signal_rank_corr")).alias("nearest")), "expression_hash", "left")


def augmented(spark, d) -> DataFrame:
    out = j.asof(minute_panel(spark, d), _facts(spark, d, False), ["code"], "date", "source_date", ["spent", "n"])
    out = j.asof_market(out, _market(spark, d, False), "date", "source_date", ["mood"])
    return j.event_cutoff_join(out, _once(spark, d, False), ["first_value"])


def rewards(spark, d) -> DataFrame:
    """The reward pipeline for eight candidates: sleeves at four horizons, curves, their summary and resampled days."""
    texts = {f"c{k}": t for k, t in enumerate(batch_formulas()[::4])}
    panel = evaluate(minute_panel(spark, d), texts)
    panel = panel.withColumns({f"__r{h}": m.forward_return(panel, h) for h in CANDIDATE_HORIZONS})
    pairs = [F.struct(F.lit(c).alias("candidate"), F.lit(h).alias("horizon"), F.col(c).alias("signal"), F.col(f"__r{h}").alias("label")) for c in texts for h in CANDIDATE_HORIZONS]
    by = ["candidate", "horizon", "shard_index"]
    rows = panel.select("code", "trade_time", "shard_index", F.inline(F.array(*pairs)))
    ranked = rows.withColumns({"signal_rank": m.section_rank("signal", [*by, "trade_time"]), "direction": F.lit(1.0)})
    curve = m.sleeve_curve(m.portfolio_returns(ranked, by, least=2), ["candidate"]).persist()
    boots = m.day_bootstrap(m.daily_returns(curve, ["candidate"]), ["candidate"])
    return m.curve_summary(curve, ["candidate"]).join(boots, "candidate")


def validation(spark, d) -> DataFrame:
    return m.quarterly_validation(catalog_metrics.work(spark, d))


WORK = {"operators_20": operators_20, "candidates_32": candidates_32, "asof_augment": augmented, "reward_audit": rewards, "quarterly_validation": validation}


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds, cold = {}, {}
    try:
        for name, run in WORK.items():
            for kind in (cold, seconds):  # the second run counts: code is compiled by then
                spark.catalog.clearCache()
                began = time.time()
                run(spark, sf_dir).write.format("noop").mode("overwrite").save()
                kind[name] = round(time.time() - began, 3)
        minutes = minute_panel(spark, sf_dir).count()
    finally:
        spark.stop()
    rate = round(len(batch_formulas()) * len(CANDIDATE_HORIZONS) * minutes / seconds["candidates_32"], 1)
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "cold": cold, "candidate_horizon_rows_per_sec": rate, "cpus": int(cpus), "sf": sf_dir.rsplit("sf", 1)[-1]}
    print(json.dumps(line))
    return 0


if __name__ == "__main__":
    sys.exit(main())
