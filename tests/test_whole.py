"""Queries over whole tables: no row is left out, whatever the table's size."""

import datetime as dt
import os

import pytest

from spindrift.catalog import load
from spindrift.operators import joins as j
from spindrift.operators import ledgers as led
from spindrift.operators import metrics as m
from spindrift.sources.panels import table

FOLDER = "/root/testdata/sf0.01"
CATALOG = load()

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@needs_tables
def test_redundancy_of_all_fields(spark):
    n = table(spark, FOLDER, "supplier").count()
    out = CATALOG.queries["field_redundancy_whole"](spark, FOLDER).collect()
    vector = lambda k: (k % 3, k % 5, k % 2, 1, k % 7)
    size = lambda v: sum(x * x for x in v) ** 0.5
    keys = [r.s_suppkey for r in table(spark, FOLDER, "supplier").collect()]
    expected = set()
    for a in keys:
        for b in keys:
            u, v = vector(a), vector(b)
            if f"f{a}" < f"f{b}" and sum(x * y for x, y in zip(u, v, strict=True)) >= (0.92 - 1e-12) * size(u) * size(v):
                expected.add((f"f{a}", f"f{b}"))
    assert n > 60 and len(out) == len(expected) and {(r.left_field, r.right_field) for r in out} == expected
    profiles = CATALOG.queries["expr_profile_whole"](spark, FOLDER).collect()
    assert {(r.expression, r.dim) for r in profiles} == {(f"e{k % 8}", d) for k in keys for d in range(5)}


def test_redundancy_forms_no_pair_of_all_fields(spark):
    rows = [(f"f{k}", [float(k % 3), -1.0, float(k % 5)]) for k in range(40)] + [("nil", [0.0, 0.0, 0.0]), ("gap", [1.0, None, 2.0]), ("none", None)]
    profiles = spark.createDataFrame(rows, "field string, vector array<double>")
    out = led.redundant_fields(profiles, 0.9)
    assert "NestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
    pairs = {(r.left_field, r.right_field) for r in out.collect()}
    cosine = lambda u, v: sum(x * y for x, y in zip(u, v, strict=True)) / (sum(x * x for x in u) * sum(y * y for y in v)) ** 0.5
    assert pairs == {(f, g) for f, u in rows[:40] for g, v in rows[:40] if f < g and cosine(u, v) >= 0.9}


@needs_tables
def test_joins_see_every_row(spark):
    for name, sql in CATALOG.oracle.items():
        if f"{name}_whole" in CATALOG.oracle and "% 3 = 0 and day" in sql:
            assert "% 3 = 0 and day" not in CATALOG.oracle[f"{name}_whole"]
    events = table(spark, FOLDER, "events")
    merged = CATALOG.queries["outer_context_merge_whole"](spark, FOLDER).selectExpr("sum(n)", "count(cutoff_minute)").first()
    assert merged[0] == events.where("event_type = 'purchase'").count()
    assert merged[1] == events.where("event_type = 'error'").selectExpr("user_id % 10", "to_date(ts)").distinct().count()
    moods = CATALOG.queries["asof_market_whole"](spark, FOLDER).where("mood is not null").selectExpr("to_date(trade_time) as day", "mood").distinct()
    assert moods.count() == moods.select("mood").distinct().count()  # each day has a day before it of its own


def test_gaps_are_looked_back_over(spark):
    day = lambda n: dt.date(2024, 1, n)
    left = spark.createDataFrame([("a", day(n)) for n in range(1, 8)], "code string, date date")
    right = spark.createDataFrame([("a", day(1), 1.0), ("a", day(5), None), ("b", day(2), 9.0)], "code string, source_date date, v double")
    out = j.asof(left, right, ["code"], "date", "source_date", ["v"]).orderBy("date").collect()
    assert [r.v for r in out] == [None, 1.0, 1.0, 1.0, 1.0, None, None]


@needs_tables
def test_checkpoint_has_every_row_once(spark):
    out = CATALOG.queries["incremental_checkpoint"](spark, FOLDER).collect()
    rows = table(spark, FOLDER, "supplier").select("s_suppkey", "s_acctbal").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, rows)) and len(rows) > 9


@pytest.mark.parametrize("name, module, operator, draws", [("bx_audit", led, "proxy_audit", 2000), ("block_bootstrap", m, "day_bootstrap", 1000)])
def test_draws_of_resampling(spark, monkeypatch, name, module, operator, draws):
    asked = []
    monkeypatch.setattr(module, operator, lambda *a, iterations=None, **b: asked.append(iterations))
    CATALOG.queries[name](spark, "/root/testdata/sf0.001")
    assert asked == [draws]
