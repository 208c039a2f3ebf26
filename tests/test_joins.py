"""Point-in-time joins: never a fact of the same day or later."""

import datetime as dt
import random

import pytest

from spindrift.operators import joins as j

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_strictly_before(spark):
    left = spark.createDataFrame([("a", D(3)), ("a", D(5)), ("b", D(1)), ("a", None), (None, D(4))], "code string, date date")
    right = spark.createDataFrame([("a", D(3), 1.0), ("a", D(4), 2.0)], "code string, source_date date, v double")
    out = {(r.code, r.date): r.v for r in j.asof(left, right, ["code"], "date", "source_date", ["v"]).collect()}
    assert out == {("a", D(3)): None, ("a", D(5)): 2.0, ("b", D(1)): None, ("a", None): None, (None, D(4)): None}


def test_against_search(spark):
    rng = random.Random(1)
    left = [(f"c{rng.randrange(5)}", D(rng.randrange(40)), k) for k in range(300)]
    right = [(f"c{rng.randrange(6)}", D(rng.randrange(40)), None if rng.random() < 0.2 else float(rng.randrange(50))) for _ in range(80)]
    right = list({(c, d): (c, d, v) for c, d, v in right}.values())
    frames = spark.createDataFrame(left, "code string, date date, k int"), spark.createDataFrame(right, "code string, source_date date, v double")
    out = {r.k: r.v for r in j.asof(*frames, ["code"], "date", "source_date", ["v"]).collect()}
    assert len(out) == 300
    for c, d, k in left:
        before = [(x, v) for cc, x, v in right if cc == c and x < d]
        assert out[k] == (max(before, key=lambda p: p[0])[1] if before else None)
    market = spark.createDataFrame([(D(5), 1.0), (D(20), None), (D(30), 3.0)], "source_date date, mood double")
    out = {r.k: r.mood for r in j.asof_market(frames[0], market, "date", "source_date", ["mood"]).collect()}
    assert all(out[k] == (None if d <= D(5) else 1.0 if d <= D(20) else None if d <= D(30) else 3.0) for _, d, k in left)


def test_statements_wait_for_their_notice(spark):
    left = spark.createDataFrame([("a", D(k)) for k in (10, 11, 101, 200)], "code string, date date")
    schema = "code string, notice_date date, update_date date, report_date date, profit double"
    noticed = spark.createDataFrame([("a", D(10), D(5), D(0), 1.0)], schema)
    assert [r.profit for r in j.asof_statements(left, noticed, ["profit"]).orderBy("date").collect()] == [None, 1.0, 1.0, 1.0]
    bare = spark.createDataFrame([("a", None, None, D(10), 2.0)], schema)
    assert [r.profit for r in j.asof_statements(left, bare, ["profit"]).orderBy("date").collect()] == [None, None, 2.0, 2.0]


def test_rows_stay(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    right = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "k int, v int, o int")
    assert {(r.k, r.v) for r in j.join_keeping_rows(left, right, ["k"], ["o"]).collect()} == {(1, 6), (2, None)}
    with pytest.raises(Exception):
        j.join_keeping_rows(left, right, ["nothing"], ["o"])


def test_merge_of_contexts(spark):
    a = spark.createDataFrame([("x", 1, 10)], "code string, d int, v int")
    b = spark.createDataFrame([("x", 1, 99, 5), ("y", 2, 98, 6)], "code string, d int, v int, w int")
    assert {tuple(r) for r in j.outer_merge([a, b], ["code", "d"]).collect()} == {("x", 1, 10, 5), ("y", 2, None, 6)}
