"""Formula operators, one query each, over the daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.catalog import Catalog
from spindrift.catalog.panels_sql import DAILY, MINUTE
from spindrift.functions.numeric import steady_round as rnd
from spindrift.plans.compiler import evaluate
from spindrift.sources.panels import daily_panel, minute_panel

W = "(partition by code order by date rows between {0} preceding and current row)"
T = "(partition by code order by date)"
X = "(partition by date)"


def _full(column: str, n: int, value: str, needed: int | None = None) -> str:
    frame = W.format(n - 1)
    return f"case when count({column}) over {frame} >= {n if needed is None else needed} then {value} over {frame} end"


def _rank(column: str, section: str = "date") -> str:
    return (
        f"case when {column} is not null then (rank() over (partition by {section} order by {column} nulls last) + (count({column}) over (partition by {section}, {column}) - 1) / 2.0)"
        f" / count({column}) over (partition by {section}) end"
    )


def _corr(n: int, least: int) -> str:
    f = W.format(n - 1)
    return f"case when count(u) over {f} >= {least} then covar_samp(u, v) over {f} / nullif(stddev_samp(u) over {f} * stddev_samp(v) over {f}, 0) end"


_JOINT = "j as (select *, case when gappy is not null then gappy end as u, case when gappy is not null then volume end as v from daily)"
_EVENT = "e as (select *, case when gappy is null then null when close > open * 1.02 then 1.0 else 0.0 end as ev, row_number() over (partition by code order by date) as rn from daily)"

#: Name: (formulas, SQL of their values over the daily panel, further WITH parts, the table read).
CASES: dict[str, tuple[dict[str, str], dict[str, str], str, str]] = {
    "expr_field": ({"a": "$close", "b": "$volt", "c": "$gappy"}, {"a": "close", "b": "volume", "c": "gappy"}, "", "daily"),
    "expr_arith": (
        {"a": "Add($close,$open)", "b": "Sub($gappy,$volume)", "c": "Mul($close,2.5)"},
        {"a": "close + open", "b": "gappy - volume", "c": "close * 2.5"},
        "",
        "daily",
    ),
    "expr_div": ({"a": "Div($gappy,$volume)", "b": "Div($close,Sub($volume,$volume))"}, {"a": "gappy / nullif(volume, 0)", "b": "cast(null as double)"}, "", "daily"),
    "expr_unary": (
        {"a": "Abs(Sub($close,$open))", "b": "Sign(Sub($close,$open))", "c": "Log($gappy)", "d": "Neg($close)", "e": "Log(Sub($close,$close))"},
        {"a": "abs(close - open)", "b": "cast(sign(close - open) as double)", "c": "ln(abs(gappy))", "d": "-close", "e": "cast(null as double)"},
        "",
        "daily",
    ),
    "expr_csrank": ({"a": "CSRank($gappy)", "b": "Rank($volume)"}, {"a": _rank("gappy"), "b": _rank("volume")}, "", "daily"),
    "expr_zscore": (
        {"a": "ZScore($gappy)"},
        {"a": f"case when count(gappy) over {X} >= 2 then (gappy - avg(gappy) over {X}) / nullif(stddev_samp(gappy) over {X}, 0) end"},
        "",
        "daily",
    ),
    "expr_csresidual": (
        {"a": "CSResidual($gappy,$volume)"},
        {"a": f"case when u is not null and count(u) over {X} >= 5 then u - avg(u) over {X} - covar_pop(u, v) over {X} / nullif(var_pop(v) over {X}, 0) * (v - avg(v) over {X}) end"},
        _JOINT,
        "j",
    ),
    "expr_safe_csresidual": (
        {"a": "SafeCSResidual($gappy,$volume,6,3,0.8)"},
        {
            "a": f"case when u is not null and count(u) over {X} >= 6 and count(distinct v) over {X} >= 3 and count(u) over {X} >= 0.8 * count(*) over {X}"
            f" then u - avg(u) over {X} - covar_pop(u, v) over {X} / nullif(var_pop(v) over {X}, 0) * (v - avg(v) over {X}) end"
        },
        _JOINT,
        "j",
    ),
    "expr_ts_mean": ({"a": "Mean($gappy,4)"}, {"a": _full("gappy", 4, "avg(gappy)")}, "", "daily"),
    "expr_ts_std": ({"a": "Std($gappy,4)"}, {"a": _full("gappy", 4, "stddev_samp(gappy)")}, "", "daily"),
    "expr_ts_mom": ({"a": "Mom($gappy,3)"}, {"a": f"gappy / nullif(lag(gappy, 3) over {T}, 0) - 1"}, "", "daily"),
    "expr_ts_delay": ({"a": "Delay($gappy,2)", "b": "Delay(Neg($close),1)"}, {"a": f"lag(gappy, 2) over {T}", "b": f"-lag(close, 1) over {T}"}, "", "daily"),
    "expr_ts_delta": ({"a": "Delta($volume,3)"}, {"a": f"volume - lag(volume, 3) over {T}"}, "", "daily"),
    "expr_ts_wma": (
        {"a": "Wma($gappy,3)"},
        {"a": f"(gappy * 3 + lag(gappy, 1) over {T} * 2 + lag(gappy, 2) over {T}) / 6"},
        "",
        "daily",
    ),
    "expr_ts_med": ({"a": "Med($gappy,5)"}, {"a": _full("gappy", 5, "quantile_cont(gappy, 0.5)")}, "", "daily"),
    "expr_ts_kurt": ({"a": "Kurt($close,8)"}, {"a": _full("close", 8, "kurtosis(close)")}, "", "daily"),
    "expr_ts_skew": ({"a": "Skew($close,6)"}, {"a": _full("close", 6, "skewness(close)")}, "", "daily"),
    "expr_ts_corr": ({"a": "Corr($gappy,$volume,8)", "b": "Corr($gappy,$volume)"}, {"a": _corr(8, 5), "b": _corr(20, 5)}, _JOINT, "j"),
    "expr_ts_cov": ({"a": "Cov($gappy,$volume,6)"}, {"a": f"case when count(u) over {W.format(5)} >= 5 then covar_samp(u, v) over {W.format(5)} end"}, _JOINT, "j"),
    "expr_event_age": (
        {"a": "EventAge($ev)", "b": "SinceLastEvent($ev)"},
        dict.fromkeys("ab", "cast(rn - max(case when ev != 0 then rn end) over (partition by code order by date rows unbounded preceding) as double)"),
        _EVENT,
        "e",
    ),
    "expr_event_count": ({"a": "EventCount($ev,5)"}, {"a": _full("ev", 5, "sum(case when ev is null then null when ev != 0 then 1.0 else 0.0 end)")}, _EVENT, "e"),
    "expr_window_state_count": ({"a": "WindowStateCount($ev,4)"}, {"a": _full("ev", 4, "sum(case when ev is null then null when ev != 0 then 1.0 else 0.0 end)")}, _EVENT, "e"),
    "expr_state_age": (
        {"a": "StateAge($level)"},
        {"a": "case when level is not null then cast(row_number() over (partition by code, island order by date) as double) end"},
        f"""s0 as (select *, case when level is null or lag(level) over {T} is null or level != lag(level) over {T} then 1 else 0 end as fresh from daily),
        s as (select *, sum(fresh) over (partition by code order by date rows unbounded preceding) as island from s0)""",
        "s",
    ),
    "expr_state_dwell": (
        {"a": "StateDwell($level,2)", "b": "StateDwell($level,0)"},
        {
            "a": "case when level is not null then least(2.0, cast(row_number() over (partition by code, island order by date) as double)) end",
            "b": "case when level is not null then cast(row_number() over (partition by code, island order by date) as double) end",
        },
        f"""s0 as (select *, case when level is null or lag(level) over {T} is null or level != lag(level) over {T} then 1 else 0 end as fresh from daily),
        s as (select *, sum(fresh) over (partition by code order by date rows unbounded preceding) as island from s0)""",
        "s",
    ),
    "expr_valid_ratio_gate": (
        {"a": "ValidRatioGate($gappy,6,0.8)"},
        {"a": f"case when avg(case when gappy is null then 0.0 else 1.0 end) over {W.format(5)} >= 0.8 then gappy end"},
        "",
        "daily",
    ),
    "expr_masked_zscore": (
        {"a": "MaskedZScore($gappy,6,0.8)"},
        {"a": f"case when count(g) over {X} >= 2 then (g - avg(g) over {X}) / nullif(stddev_samp(g) over {X}, 0) end"},
        f"m as (select *, case when avg(case when gappy is null then 0.0 else 1.0 end) over {W.format(5)} >= 0.8 then gappy end as g from daily)",
        "m",
    ),
    "expr_masked_corr": (
        {"a": "MaskedCorr($gappy,$volume,8,0.8)"},
        {"a": f"case when avg(case when u is null then 0.0 else 1.0 end) over {W.format(7)} >= 0.8 then {_corr(8, 7)} end"},
        _JOINT,
        "j",
    ),
    "expr_derived_sugar": (
        {"a": "$ma4", "b": "$gappy_ma_4", "c": "$mom3", "d": "$volume_lag2", "e": "$close_std_6"},
        {
            "a": _full("close", 4, "avg(close)"),
            "b": _full("gappy", 4, "avg(gappy)"),
            "c": f"close / nullif(lag(close, 3) over {T}, 0) - 1",
            "d": f"lag(volume, 2) over {T}",
            "e": _full("close", 6, "stddev_samp(close)"),
        },
        "",
        "daily",
    ),
}


def _with_event(panel):
    return panel.withColumn("ev", F.when(F.col("gappy").isNotNull(), F.when(F.col("close") > F.col("open") * 1.02, 1.0).otherwise(0.0)))


#: Values of large size are compared to fewer places.
DIGITS = {"expr_csresidual": 3, "expr_safe_csresidual": 3, "expr_ts_cov": 0}


def _case(formulas: dict[str, str], digits: int):
    def run(spark, sf_dir):
        panel = _with_event(daily_panel(spark, sf_dir))
        return evaluate(panel, formulas).select("code", "date", *[rnd(F.col(name), digits).alias(name) for name in formulas])

    return run


FLAGSHIP = "CSRank(Sub(ZScore(Delta($volume,3)),Mean($close,5)))"


def register(catalog: Catalog) -> None:
    for name, (formulas, values, more, source) in CASES.items():
        digits = DIGITS.get(name, 6)
        columns = ", ".join(f"round({v}, {digits}) as {k}" for k, v in values.items())
        catalog.add(name, _case(formulas, digits), f"with {DAILY}{',' if more else ''} {more} select code, date, {columns} from {source}")

    @catalog.query(
        "expr_nested",
        f"""with {DAILY}, a as (select *, volume - lag(volume, 3) over {T} as d, {_full("close", 5, "avg(close)")} as m from daily),
        b as (select *, case when count(d) over {X} >= 2 then (d - avg(d) over {X}) / nullif(stddev_samp(d) over {X}, 0) end - m as v from a)
        select code, date, round({_rank("v")}, 6) as signal from b""",
    )
    def expr_nested(spark, sf_dir):
        return evaluate(daily_panel(spark, sf_dir), {"signal": FLAGSHIP}).select("code", "date", rnd(F.col("signal"), 6).alias("signal"))

    @catalog.query(
        "expr_minute",
        f"""with {MINUTE}, a as (select *, case when count(close) over w >= 6 then avg(close) over w end as m from minute window w as (partition by code order by trade_time rows between 5 preceding and current row))
        select code, trade_time, round({_rank("m", "trade_time")}, 6) as signal from a""",
    )
    def expr_minute(spark, sf_dir):
        return evaluate(minute_panel(spark, sf_dir), {"signal": "CSRank(Mean($close,6))"}).select("code", "trade_time", rnd(F.col("signal"), 6).alias("signal"))

    @catalog.query(
        "signal_clock",
        f"""with {DAILY}, a as (select *, lag(close) over {T} as c1, lag(open) over {T} as o1 from daily)
        select code, date, round({_full("c1", 3, "avg(c1)")}, 6) as after_open, round(o1 - c1, 6) as pre_open, round(open - close, 6) as after_close,
          round(lag(close, 2) over {T}, 6) as longer_delay from a""",
    )
    def signal_clock(spark, sf_dir):
        from spindrift.operators.features import clock_lags

        panel = daily_panel(spark, sf_dir)
        out = evaluate(panel, {"after_close": "Sub($open,$close)"}, clock_lags("after_close"))
        out = evaluate(out, {"after_open": "Mean($close,3)", "longer_delay": "Delay($close,2)"}, clock_lags("after_open"))
        out = evaluate(out, {"pre_open": "Sub($open,$close)"}, clock_lags("pre_open"))
        return out.select("code", "date", *[rnd(F.col(c), 6).alias(c) for c in ("after_open", "pre_open", "after_close", "longer_delay")])
