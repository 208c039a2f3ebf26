"""Typed primitives on the fixed 4 x 16 panel, and what it is known to give."""

import datetime as dt

import pytest

from spindrift.plans.compiler import evaluate

FLAG, RANK, TURN = "limit_up_any_close_not_open_in_t10", "high_board_rank", "turnover_ratio"
START = dt.datetime(2026, 6, 1, 9, 31)


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for c in range(4):
        for t in range(16):
            time = START + dt.timedelta(minutes=t)
            flag = 1.0 if t in (3 + c, 9) and c != 3 else 0.0
            turn = None if c == 3 and t < 8 else 0.5 + 0.2 * c + 0.03 * t
            rows.append((f"00000{c + 1}.SZ", time, time, 10 + c + 0.01 * t, 1000.0 + 250 * c + 17 * t, flag, float((t // 3 + c) % 4), turn))
    return spark.createDataFrame(rows, f"code string, date timestamp, trade_time timestamp, close double, amount double, {FLAG} double, {RANK} double, {TURN} double").cache()


#: Formula: (values, different values, lowest, highest, minutes after the start of the first).
GOLDEN = {
    f"CSRank(EventCount(${FLAG},5))": (48, 6, 0.25, 1.0, 4),
    f"CSRank(EventAge(${FLAG}))": (36, 4, 1 / 3, 1.0, 3),
    f"CSRank(StateDwell(${RANK},5))": (64, 1, 0.625, 0.625, 0),
    f"CSRank(WindowStateCount(${RANK},10))": (28, 4, 0.375, 1.0, 9),
    f"CSRank(ValidRatioGate(${TURN},6,0.8))": (52, 6, 0.25, 1.0, 0),
    f"CSRank(MaskedZScore(${TURN},6,0.8))": (52, 6, 0.25, 1.0, 0),
    f"CSRank(MaskedCorr(${TURN},$amount,6,0.5))": (48, None, 0.25, 1.0, 2),
    f"CSRank(SafeCSResidual(${TURN},$amount,2,2,0.5))": (56, 10, 0.25, 1.0, 0),
}


@pytest.mark.parametrize("text", GOLDEN)
def test_golden_rows(panel, text):
    count, different, low, high, first = GOLDEN[text]
    rows = [r for r in evaluate(panel, {"v": text}).collect() if r.v is not None]
    values = [r.v for r in rows]
    assert len(values) == count and min(values) == pytest.approx(low) and max(values) == pytest.approx(high)
    assert different is None or len({round(v, 9) for v in values}) == different
    assert min(r.trade_time for r in rows) == START + dt.timedelta(minutes=first)


def test_semantics(panel):
    out = {(r.code, round((r.trade_time - START).total_seconds() / 60)): r for r in evaluate(panel, {"age": f"EventAge(${FLAG})", "n": f"EventCount(${FLAG},5)", "gate": f"ValidRatioGate(${TURN},6,0.8)"}).collect()}
    for c in range(3):
        code = f"00000{c + 1}.SZ"
        assert all(out[code, t].age is None for t in range(3 + c)) and out[code, 3 + c].age == 0 and out[code, 9].age == 0
    assert all(out[code, t].n is None for code in ("000001.SZ", "000004.SZ") for t in range(4))
    assert all(out["000004.SZ", t].gate is None for t in range(8))
