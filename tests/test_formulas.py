"""Formulas against plain Python, on panels with every awkward case."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from spindrift.plans.compiler import Compiler, evaluate
from spindrift.plans.expr import UnsupportedExpression, canonical, fields, max_window, parse
from spindrift.sources.panels import Keys


def panel_rows(seed=0):
    """Codes with gaps and ties; a one-row and an all-tied section; a column that never varies, one that is never there."""
    rng = random.Random(seed)
    rows = []
    for c in range(7):
        for t in range(14):
            if c == 3 and t in (4, 5):
                continue
            x = None if rng.random() < 0.15 else float(rng.randint(-3, 6))
            y = None if rng.random() < 0.1 else round(rng.uniform(-5, 5), 3)
            if t == 9:
                x = 2.0
            rows.append((f"c{c}", t, x, y, 1.0, None, float("nan") if t == 2 and c == 1 else (float("inf") if t == 3 and c == 2 else y)))
    rows.append(("c0", 99, 5.0, 1.0, 1.0, None, 1.0))
    return rows


@pytest.fixture(scope="module")
def panel(spark):
    raw = spark.createDataFrame(panel_rows(), "code string, t int, x double, y double, flat double, none double, odd double")
    return raw.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t"))).cache()


def column(panel, text, **options):
    rows = evaluate(panel, {"v": text}, **options).select("code", "t", "v").collect()
    return {(r.code, r.t): r.v for r in rows}


DATA = {(r[0], r[1]): r for r in panel_rows()}
SERIES = {c: sorted(t for cc, t in DATA if cc == c) for c in {k[0] for k in DATA}}


def value(k, i):
    v = DATA[k][i]
    return None if v is None or not math.isfinite(v) else v


def history(k, n, i=2):
    c, t = k
    place = SERIES[c].index(t)
    return [value((c, u), i) for u in SERIES[c][max(0, place - n + 1) : place + 1]], place + 1 >= n


def rolled(n, fn, i=2, least=None):
    def one(k):
        values, _ = history(k, n, i)
        good = [v for v in values if v is not None]
        return fn(good) if len(good) >= (least or n) else None

    return one


def moment_skew(v):
    n, m = len(v), statistics.fmean(v)
    m2, m3 = (sum((x - m) ** p for x in v) / n for p in (2, 3))
    return None if m2 == 0 else m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)


def moment_kurt(v):
    n, m = len(v), statistics.fmean(v)
    m2, m4 = (sum((x - m) ** p for x in v) / n for p in (2, 4))
    return None if m2 == 0 else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6)


CASES = {
    "Mean($x,3)": rolled(3, statistics.fmean),
    "Std($x,3)": rolled(3, statistics.stdev),
    "Med($x,4)": rolled(4, statistics.median),
    "Skew($y,5)": rolled(5, moment_skew, 3),
    "Kurt($y,6)": rolled(6, moment_kurt, 3),
    "Wma($x,3)": rolled(3, lambda v: sum((i + 1) * x for i, x in enumerate(v)) / 6),
    "EventCount($x,3)": rolled(3, lambda v: float(sum(x != 0 for x in v))),
    "Mean($odd,1)": lambda k: value(k, 6),
    "Mean($none,2)": lambda k: None,
    "Std($flat,2)": rolled(2, lambda v: 0.0, 4),
}


@pytest.mark.parametrize("text", CASES)
def test_series_operators(panel, text):
    got = column(panel, text)
    for k in DATA:
        want = CASES[text](k)
        assert (got[k] is None) == (want is None), (text, k, got[k], want)
        if want is not None:
            assert math.isclose(got[k], want, rel_tol=1e-9, abs_tol=1e-9), (text, k)


def section(t):
    return [k for k in DATA if k[1] == t]


def test_rank_and_zscore(panel):
    ranks, scores = column(panel, "CSRank($x)"), column(panel, "ZScore($x)")
    for k in DATA:
        values = [value(j, 2) for j in section(k[1]) if value(j, 2) is not None]
        v = value(k, 2)
        if v is None:
            assert ranks[k] is None and scores[k] is None
            continue
        below, same = sum(x < v for x in values), sum(x == v for x in values)
        assert math.isclose(ranks[k], (below + (same + 1) / 2) / len(values))
        spread = statistics.stdev(values) if len(values) > 1 else 0
        if spread == 0:
            assert scores[k] is None
        else:
            assert math.isclose(scores[k], (v - statistics.fmean(values)) / spread, abs_tol=1e-12)


@pytest.mark.parametrize("text, least, distinct, share", [("CSResidual($y,$x)", 5, 0, 0.0), ("SafeCSResidual($y,$x,3,3,0.8)", 3, 3, 0.8)])
def test_residuals(panel, text, least, distinct, share):
    got = column(panel, text)
    for k in DATA:
        rows = section(k[1])
        both = [(value(j, 3), value(j, 2)) for j in rows if value(j, 3) is not None and value(j, 2) is not None]
        mine = value(k, 3), value(k, 2)
        xs = [x for _, x in both]
        if None in mine or len(both) < least or len(set(xs)) < max(distinct, 2) or len(both) < share * len(rows):
            assert got[k] is None
            continue
        my, mx = statistics.fmean(y for y, _ in both), statistics.fmean(xs)
        slope = sum((y - my) * (x - mx) for y, x in both) / sum((x - mx) ** 2 for x in xs)
        assert math.isclose(got[k], mine[0] - my - slope * (mine[1] - mx), abs_tol=1e-9)
    assert all(v is None for v in column(panel, "CSResidual($y,$flat)").values())


def test_relations(panel):
    corr, cov, flat = column(panel, "Corr($x,$y,6)"), column(panel, "Cov($x,$y,6)"), column(panel, "Corr($flat,$y,6)")
    for k in DATA:
        xs, ys = history(k, 6)[0], history(k, 6, 3)[0]
        both = [(x, y) for x, y in zip(xs, ys, strict=True) if x is not None and y is not None]
        if len(both) < 5:
            assert corr[k] is None and cov[k] is None
            continue
        a, b = zip(*both, strict=True)
        c = statistics.covariance(a, b)
        assert math.isclose(cov[k], c, abs_tol=1e-9)
        spread = statistics.stdev(a) * statistics.stdev(b)
        assert corr[k] is None if spread == 0 else math.isclose(corr[k], c / spread, abs_tol=1e-9)
        assert flat[k] is None


def test_events_and_states(panel):
    age, run, capped = column(panel, "EventAge($x)"), column(panel, "StateAge($x)"), column(panel, "StateDwell($x,2)")
    for c, times in SERIES.items():
        since, length, last = None, 0, None
        for t in times:
            v = value((c, t), 2)
            since = 0 if v not in (None, 0.0) else (None if since is None else since + 1)
            assert age[c, t] == since
            length = 0 if v is None else (length + 1 if v == last else 1)
            last = v
            assert run[c, t] == (None if v is None else length) and capped[c, t] == (None if v is None else min(length, 2))


def test_elementwise_and_missing(panel):
    got = column(panel, "Div($y,Sub($x,$x))")
    assert all(v is None for v in got.values())
    assert all(v is None for k, v in column(panel, "Log($x)").items() if value(k, 2) in (None, 0.0))
    mom = column(panel, "Mom($x,2)")
    for c, times in SERIES.items():
        for i, t in enumerate(times):
            before, now = (value((c, times[i - 2]), 2) if i >= 2 else None), value((c, t), 2)
            assert mom[c, t] is None if before in (None, 0.0) or now is None else math.isclose(mom[c, t], now / before - 1)


def test_late_fields(panel):
    plain, late = column(panel, "Delay($x,1)"), column(panel, "$x", lags={"x": 1})
    assert plain == late
    assert column(panel, "Delay($x,2)", lags={"x": 1}) == column(panel, "Delay($x,2)")
    assert column(panel, "Delay(Neg($x),1)", lags={"x": 1}) == column(panel, "Delay(Neg($x),2)")


def test_nothing_later_is_seen(spark, panel):
    """Rows after a time can't change signals at or before it."""
    texts = {"a": "CSRank(Sub(ZScore(Delta($x,2)),Mean($y,3)))", "b": "MaskedCorr($x,$y,5,0.6)", "c": "StateDwell($x,3)"}
    changed = panel.withColumns({c: F.when(F.col("t") > 6, -F.col(c) * 7 + 1).otherwise(F.col(c)) for c in ("x", "y")})
    before, after = ({(r.code, r.t): (r.a, r.b, r.c) for r in evaluate(p, texts).where("t <= 6").collect()} for p in (panel, changed))
    assert before == after


def test_steps_are_shared(panel):
    compiler = Compiler(Keys(), panel.columns)
    for text in ("CSRank(Mean($x,3))", "ZScore(Mean($x,3))", "Sub(Mean($x,3),Mean($x,3))"):
        compiler.compile(parse(text))
    assert sum(k[0] == "mean" for k in compiler.steps) == 1


def test_one_exchange_for_each_turn(panel):
    out = evaluate(panel, {"a": "CSRank(Sub(Mean($x,3),Std($y,4)))", "b": "ZScore(Delta($x,2))"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(code") <= 1


def test_parser():
    assert canonical("csrank( mean($ma5 , 3) )") == "CSRank(Mean(Mean($close,5),3))"
    assert canonical("Corr($a,$b)") == "Corr($a,$b,20)"
    assert canonical("$volt") == "$volume" and canonical("$close_mom_999") == "Mom($close,252)"
    assert fields(parse("Add($b,Mul($a,$b))")) == ["a", "b"]
    assert max_window(parse("Mean(Std($a,10),5)")) == 10 and max_window(parse("Corr($a,$b)")) == 20
    for bad in ("EventTransition($a)", "Mean($a)", "Mean($a,$b)", "Foo($a)", "Add($a,$b", "Add($a,$b))", "", "close", "GroupRank($a,$b)"):
        with pytest.raises(UnsupportedExpression):
            parse(bad)


def test_unknown_field(panel):
    with pytest.raises(UnsupportedExpression, match="missing_field:zz"):
        evaluate(panel, {"v": "Mean($zz,2)"})


def test_deep_formula(panel):
    text = "$x"
    for k in range(12):
        text = f"CSRank(Mean({text},2))" if k % 2 else f"ZScore({text})"
    assert any(v is not None for v in column(panel, text).values())
