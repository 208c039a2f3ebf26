"""Derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.catalog import Catalog
from spindrift.catalog.panels_sql import DAILY, MINUTE
from spindrift.functions.numeric import steady_round as rnd
from spindrift.operators import features as f
from spindrift.sources.panels import daily_panel, minute_panel

T = "(partition by code order by date)"


def _change(n: int, column: str = "close") -> str:
    return f"{column} / nullif(lag({column}, {n}) over {T}, 0) - 1"


def _rounded(df, keys, columns, digits=6):
    return df.select(*keys, *[rnd(F.col(c), digits).alias(c) for c in columns])


def _with_move(panel):
    return panel.withColumn("rt_change_pct", f.change("close", 1) * 100)


RT = f"r as (select *, 100 * ({_change(1)}) as rt_change_pct from daily)"
FLAGS = "fl as (select *, case when rt_change_pct >= 9.8 then 1.0 else 0.0 end as up, case when rt_change_pct <= -9.8 then 1.0 else 0.0 end as down from r)"


def _streak(flag: str) -> str:
    return f"row_number() over {T} - coalesce(max(case when {flag} = 0 then rn end) over (partition by code order by date rows unbounded preceding), 0)"


def _event_sql() -> str:
    """The event layer over the daily panel, whose day changes serve as close events."""
    marks = {
        "uc": "rt_change_pct >= 9.8",
        "dc": "rt_change_pct <= -9.8",
        "uo": "open / nullif(pc, 0) - 1 >= 0.098 - 1e-6",
        "do_": "open / nullif(pc, 0) - 1 <= -0.098 + 1e-6",
        "ut": "high / nullif(pc, 0) - 1 >= 0.098 - 1e-6",
        "dt": "low / nullif(pc, 0) - 1 <= -0.098 + 1e-6",
    }
    flags = ", ".join(f"case when {v} then 1.0 else 0.0 end as {k}" for k, v in marks.items())
    streaks = ", ".join(f"{_streak(k)} as s_{k}" for k in ("uc", "dc", "ut", "dt"))
    return f"""{RT}, p as (select *, lag(close) over {T} as pc, row_number() over {T} as rn from r), k as (select *, {flags} from p), s as (select *, {streaks} from k),
    h as (select *, coalesce(lag(s_uc) over {T}, 0) as b_uc, coalesce(lag(s_dc) over {T}, 0) as b_dc, max(s_uc) over (partition by date) as mh,
      dense_rank() over (partition by date order by s_uc desc) as dr from s),
    g as (select *, case when b_uc > 0 and uc = 0 then 1.0 else 0.0 end as brk, case when s_uc > 0 and s_uc = mh then 1.0 else 0.0 end as ish from h)"""


def _event_columns(longest: int) -> dict[str, str]:
    bool_ = lambda test: f"case when {test} then 1.0 else 0.0 end"
    out = {
        "limit_up_close_event": "uc",
        "limit_down_close_event": "dc",
        "limit_up_open_event": "uo",
        "limit_down_open_event": "do_",
        "limit_up_touch_event": "ut",
        "limit_down_touch_event": "dt",
        "limit_up_touch_not_close": bool_("ut = 1 and uc = 0"),
        "limit_down_touch_not_close": bool_("dt = 1 and dc = 0"),
        "limit_up_open_not_close": bool_("uo = 1 and uc = 0"),
        "limit_down_open_not_close": bool_("do_ = 1 and dc = 0"),
        "limit_up_close_not_open": bool_("uc = 1 and uo = 0"),
        "limit_down_close_not_open": bool_("dc = 1 and do_ = 0"),
        "limit_up_streak_close": "s_uc",
        "limit_down_streak_close": "s_dc",
        "limit_up_streak_touch": "s_ut",
        "limit_down_streak_touch": "s_dt",
        "limit_up_break": "brk",
        "limit_down_repair": bool_("b_dc > 0 and dc = 0"),
        "limit_flip_up_to_down": bool_("b_uc > 0 and dc = 1"),
        "limit_flip_down_to_up": bool_("b_dc > 0 and uc = 1"),
        "market_high_board": "mh",
        "is_market_high_board": "ish",
        "streak_gap_to_market_high": "mh - s_uc",
        "high_board_rank": "dr",
    }
    for n in range(1, longest + 1):
        out |= {
            f"limit_up_streak_ge_{n}": bool_(f"s_uc >= {n}"),
            f"limit_down_streak_ge_{n}": bool_(f"s_dc >= {n}"),
            f"limit_up_touch_streak_ge_{n}": bool_(f"s_ut >= {n}"),
            f"limit_down_touch_streak_ge_{n}": bool_(f"s_dt >= {n}"),
            f"break_board_after_streak_ge_{n}": bool_(f"b_uc >= {n} and uc = 0"),
            f"limit_down_rebound_after_streak_ge_{n}": bool_(f"b_dc >= {n} and dc = 0"),
        }
    for d in f.POST_HIGH_DAYS:
        out[f"post_market_high_board_tplus_{d}"] = bool_(f"coalesce(lag(ish, {d}) over {T}, 0) > 0")
        out[f"break_after_high_board_tplus_{d}"] = bool_(f"coalesce(lag(ish, {d}) over {T}, 0) > 0 and brk > 0")
    return out


def _roll(value: str, rows: int, least: int, aggregate: str = "avg", part: str = "partition by code") -> str:
    w = f"({part} order by date rows between {rows - 1} preceding and current row)"
    return f"case when count({value}) over {w} >= {least} then {aggregate}({value}) over {w} end"


def register(catalog: Catalog) -> None:
    names = ["vwap", *f.RETURN_WINDOWS, "susp"]
    sql = ", ".join([f"round({_change(n)}, 6) as {k}" for k, n in f.RETURN_WINDOWS.items()])

    @catalog.query("augment_returns", f"with {DAILY} select code, date, round(amount / nullif(volume, 0), 6) as vwap, {sql}, 0.0::double as susp from daily")
    def augment_returns(spark, sf_dir):
        return _rounded(f.augment_returns(daily_panel(spark, sf_dir)), ["code", "date"], names)

    @catalog.query("augment_turnover", f"with {DAILY}, t as (select *, {_roll('volume', 20, 5)} as m from daily) select code, date, round(volume / nullif(m, 0), 6) as turnover_rate from t")
    def augment_turnover(spark, sf_dir):
        return _rounded(f.augment_turnover(daily_panel(spark, sf_dir)), ["code", "date"], ["turnover_rate"])

    columns = ["limit_up_event", "limit_down_event", "limit_up_streak", "limit_down_streak", "limit_up_break", "limit_down_repair", "limit_flip_up_to_down", "limit_flip_down_to_up"]

    @catalog.query(
        "limit_streaks",
        f"""with {DAILY}, {RT}, {FLAGS}, n as (select *, row_number() over {T} as rn, coalesce(lag(up) over {T}, 0) as pu, coalesce(lag(down) over {T}, 0) as pd from fl)
        select code, date, up::double as limit_up_event, down::double as limit_down_event, ({_streak("up")})::double as limit_up_streak, ({_streak("down")})::double as limit_down_streak,
          case when pu > 0 and up = 0 then 1.0 else 0.0 end::double as limit_up_break, case when pd > 0 and down = 0 then 1.0 else 0.0 end::double as limit_down_repair,
          case when pu > 0 and down > 0 then 1.0 else 0.0 end::double as limit_flip_up_to_down, case when pd > 0 and up > 0 then 1.0 else 0.0 end::double as limit_flip_down_to_up from n""",
    )
    def limit_streaks(spark, sf_dir):
        return f.limit_streaks(_with_move(daily_panel(spark, sf_dir))).select("code", "date", *columns)

    event_columns = _event_columns(10)

    @catalog.query("event_derived", f"with {DAILY}, {_event_sql()} select code, date, {', '.join(f'({v})::double as {k}' for k, v in event_columns.items())} from g")
    def event_derived(spark, sf_dir):
        return f.event_features(_with_move(daily_panel(spark, sf_dir))).select("code", "date", *event_columns)

    @catalog.query(
        "event_streak",
        f"""with {DAILY}, e as (select *, row_number() over {T} as rn, case when close > open then 1.0 else 0.0 end as up from daily) select code, date, ({_streak("up")})::double as streak from e""",
    )
    def event_streak(spark, sf_dir):
        return f.streaks(daily_panel(spark, sf_dir), {"streak": F.col("close") > F.col("open")}).select("code", "date", "streak")

    source = {"close": "uc", "open": "uo", "touch": "ut", "open_not_close": "case when uo = 1 and uc = 0 then 1.0 else 0.0 end", "touch_not_close": "case when ut = 1 and uc = 0 then 1.0 else 0.0 end", "close_not_open": "case when uc = 1 and uo = 0 then 1.0 else 0.0 end"}
    window = lambda n: f"(partition by code order by date rows between {n - 1} preceding and current row)"
    counts = {f"limit_up_{k}_count_t{n}": f"sum({v}) over {window(n)}" for n in range(2, 11) for k, v in source.items()}
    anys = {f"limit_up_any_{k}_in_t{n}": f"case when sum({source[k]}) over {window(n)} > 0 then 1.0 else 0.0 end" for n in range(2, 11) for k in ("open_not_close", "close_not_open")}

    @catalog.query("event_window_counts", f"with {DAILY}, {_event_sql()} select code, date, {', '.join(f'({v})::double as {k}' for k, v in (counts | anys).items())} from g")
    def event_window_counts(spark, sf_dir):
        return f.event_window_counts(f.event_features(_with_move(daily_panel(spark, sf_dir)))).select("code", "date", *counts, *anys)

    @catalog.query(
        "feature_coverage",
        f"""with {DAILY} select 'gappy' as field, true as present, round(count(gappy) / count(*)::double, 6) as non_null_ratio, round(count(*) filter (gappy > 0) / count(*)::double, 6) as positive_ratio from daily
        union all select 'level', true, round(count(level) / count(*)::double, 6), round(count(*) filter (level > 0) / count(*)::double, 6) from daily union all select 'nothing', false, 0.0, 0.0""",
    )
    def feature_coverage(spark, sf_dir):
        return f.feature_coverage(daily_panel(spark, sf_dir), ["gappy", "level", "nothing"])

    state = lambda c: f"case when {c} <= -0.0010 then -1.0 when {c} >= 0.0015 then 1.0 when {c} is not null then 0.0 end"
    trend = ["stock_trend_eff", "stock_trend_slope", "stock_trend_state", "stock_price_position_state", "market_trend_eff", "market_trend_state", "market_breadth_state", "market_vol_state"]

    @catalog.query(
        "trend_state",
        f"""with {DAILY}, a as (select *, {_change(1)} as ret from daily),
        b as (select *, {_roll("ret", 20, 8)} as te, {_roll("ret", 5, 5)} as sh, {_roll("high", 20, 8, "max")} as hi, {_roll("low", 20, 8, "min")} as lo from a),
        d as (select date, avg(ret) as ew, avg(case when ret > 0 then 1.0 else 0.0 end) as up from a group by 1),
        m as (select date, {_roll("ew", 20, 8, part="")} as mt, {_roll("up", 20, 8, part="")} as mb, {_roll("ew", 20, 8, "stddev_pop", "")} as mv from d)
        select code, date, round(te, 6) as stock_trend_eff, round(sh - te, 6) as stock_trend_slope, ({state("te")})::double as stock_trend_state, round((close - lo) / nullif(hi - lo, 0), 6) as stock_price_position_state,
          round(mt, 6) as market_trend_eff, ({state("mt")})::double as market_trend_state, round(mb, 6) as market_breadth_state, round(mv, 6) as market_vol_state from b left join m using (date)""",
    )
    def trend_state(spark, sf_dir):
        return _rounded(f.trend_state(daily_panel(spark, sf_dir)), ["code", "date"], trend)

    regime = f"""a as (select *, {_change(1)} as ret, 100 * ({_change(1)}) as rt from daily),
    d as (select date, avg(ret) as ew_return, count(*) filter (ret > 0) / nullif(count(ret), 0)::double as up_ratio, count(distinct code) as instrument_count, sum(amount) as amount_sum,
      count(*) filter (rt >= 9.8) / nullif(count(rt), 0)::double as lu, count(*) filter (rt <= -9.8) / nullif(count(rt), 0)::double as ld from a group by 1),
    e as (select *, coalesce(lu, 0) + coalesce(ld, 0) as den from d),
    q as (select *, {_roll("ew_return", 20, 8, part="")} as tr, {_roll("ew_return", 20, 8, "stddev_pop", "")} as vo, ({_roll("amount_sum", 20, 8, part="")}) / nullif({_roll("amount_sum", 60, 20, part="")}, 0) as li,
      {_roll("den", 5, 2, part="")} as de from e),
    z as (select *, lag(tr) over (order by date) as trend_mean_lag1, lag(vo) over (order by date) as volatility_lag1, lag(li) over (order by date) as liquidity_ratio_lag1, lag(de) over (order by date) as limit_density_lag1 from q),
    y as (select *, case when trend_mean_lag1 is null or volatility_lag1 is null then 'unknown_warmup' when limit_density_lag1 >= 0.001 then 'limit_density_high' when liquidity_ratio_lag1 < 0.75 then 'liquidity_contraction'
      when trend_mean_lag1 >= 0.0015 then 'strong_uptrend' when trend_mean_lag1 <= -0.0010 then 'drawdown' when volatility_lag1 >= 0.018 then 'high_vol_sideways' else 'sideways_or_rotation' end as pit_regime_label from z)"""
    numbers = ["ew_return", "up_ratio", "amount_sum", "trend_mean_lag1", "volatility_lag1", "liquidity_ratio_lag1", "limit_density_lag1"]

    @catalog.query("market_regime", f"with {DAILY}, {regime} select date, instrument_count, pit_regime_label, {', '.join(f'round({c}, 4) as {c}' for c in numbers)} from y")
    def market_regime(spark, sf_dir):
        return _rounded(f.market_regime(_with_move(daily_panel(spark, sf_dir))), ["date", "instrument_count", "pit_regime_label"], numbers, 4)

    @catalog.query(
        "regime_coverage",
        f"""with {DAILY}, {regime} select pit_regime_label, count(*) as days, round(avg(ew_return), 6) as mean_ew_return, round(avg(up_ratio), 6) as mean_up_ratio,
        round(avg(liquidity_ratio_lag1), 6) as mean_liquidity_ratio, round(avg(limit_density_lag1), 6) as mean_limit_density from y group by 1""",
    )
    def regime_coverage(spark, sf_dir):
        return f.regime_coverage(f.market_regime(_with_move(daily_panel(spark, sf_dir))))

    @catalog.query(
        "open_gap",
        f"""with {MINUTE}, d as (select code, date, arg_min(open, trade_time) as fo, arg_max(close, trade_time) as lc from minute group by 1, 2),
        g as (select code, date, fo / nullif(lag(lc) over {T}, 0) - 1 as open_gap from d) select code, trade_time, round(open_gap, 6) as open_gap from minute left join g using (code, date)""",
    )
    def open_gap(spark, sf_dir):
        return _rounded(f.open_gap(minute_panel(spark, sf_dir)), ["code", "trade_time"], ["open_gap"])

    items = sorted({x for pair in f.FUND_RATIOS.values() for x in pair} | set(f.FUND_ITEMS.values()))
    raw = ", ".join(f"case when s_suppkey % {k + 3} = 0 then 0.0 when s_suppkey % {k + 5} = 1 then null else s_acctbal + {100 * k} end as {c}" for k, c in enumerate(items))
    ratios = ", ".join([f"round({a} / nullif({b}, 0), 6) as {n}" for n, (a, b) in f.FUND_RATIOS.items()] + [f"round({c}, 6) as {n}" for n, c in f.FUND_ITEMS.items()])

    @catalog.query("fund_ratios", f"with s as (select s_suppkey, {raw} from supplier) select s_suppkey, {ratios} from s")
    def fund_ratios(spark, sf_dir):
        from spindrift.sources.panels import table

        no, base = F.col("s_suppkey"), F.col("s_acctbal")
        made = [F.when(no % (k + 3) == 0, 0.0).when(no % (k + 5) != 1, base + 100 * k).alias(c) for k, c in enumerate(items)]
        return _rounded(f.fund_ratios(table(spark, sf_dir, "supplier").select("s_suppkey", *made)), ["s_suppkey"], [*f.FUND_RATIOS, *f.FUND_ITEMS])

    codes = ["600001", "000001.sz", " 300750 ", "sh600000", "12", "nan", "", None, "830001", "1.SHX", "430017.BJ", "688001", "510300", "159915", "399001", "200002", "700.HK", "abc", "7654321", "870001"]
    listed = ", ".join("(null)" if c is None else f"('{c}')" for c in codes)
    norm = """n as (select c, upper(trim(coalesce(c, ''))) as t from v), d as (select *, regexp_replace(t, '\\D', '', 'g') as al, case when contains(t, '.') then substr(t, 1, strpos(t, '.') - 1) else t end as l,
      case when contains(t, '.') then substr(t, strpos(t, '.') + 1) else '' end as r from n), k as (select *, regexp_replace(l, '\\D', '', 'g') as od, regexp_replace(r, '[^A-Z]', '', 'g') as su, right(al, 6) as a6 from d),
      x as (select *, right(od, 6) as o6 from k)"""

    @catalog.query(
        "normalize_code",
        f"""with v(c) as (values {listed}), {norm} select c as raw,
        case when t in ('', 'NAN', 'NONE', 'NULL') then '' when od != '' and su != '' then lpad(o6, 6, '0') || '.' || left(su, 2) when length(al) < 6 then ''
          when a6[1] in ('0', '2', '3') then a6 || '.SZ' when a6[1] in ('4', '8', '9') then a6 || '.BJ' else a6 || '.SH' end as event_code,
        case when t in ('', 'NAN', 'NONE', 'NULL') then '' when length(od) >= 6 then case when o6[1] in ('0', '2', '3') then o6 || '.SZ' when o6[1] in ('4', '8', '9') then o6 || '.BJ' else o6 || '.SH' end else t end as adapter_code,
        case when contains(t, '.') then case when od != '' and su != '' then case when length(od) >= 6 then od else lpad(od, 6, '0') end || '.' || su else t end when length(al) < 6 then t
          when left(a6, 2) in ('60', '68', '90', '51', '52', '56', '58') then a6 || '.SH' when left(a6, 2) in ('00', '30', '15', '16', '18', '39') then a6 || '.SZ'
          when left(a6, 2) in ('43', '83', '87', '88', '92') then a6 || '.BJ' else a6 end as daily_code from x""",
    )
    def normalize_code(spark, sf_dir):
        raw = spark.createDataFrame([(c,) for c in codes], "raw string")
        return raw.select("raw", *[f.normalize_code(F.col("raw"), r).alias(f"{r}_code") for r in ("event", "adapter", "daily")])

    texts = ["09:31", "0931", "9:05 first", "at 14：05", "--", None, "25:99", "7", "1130", "x13:00y", "23:59:59"]
    listed_texts = ", ".join("(null)" if c is None else f"('{c}')" for c in texts)

    @catalog.query(
        "parse_cutoff",
        f"""with v(t) as (values {listed_texts}), m as (select t, regexp_extract(trim(coalesce(t, '')), '([01]?[0-9]|2[0-3])[:：]?([0-5][0-9])', 1) as h, regexp_extract(trim(coalesce(t, '')), '([01]?[0-9]|2[0-3])[:：]?([0-5][0-9])', 2) as mi from v)
        select t as raw, (try_cast(h as integer) * 60 + try_cast(mi as integer))::double as cutoff_minute from m""",
    )
    def parse_cutoff(spark, sf_dir):
        return spark.createDataFrame([(c,) for c in texts], "raw string").select("raw", f.parse_cutoff(F.col("raw")).alias("cutoff_minute"))

    @catalog.query("quarter_label", f"with {DAILY} select distinct date, year(date) || 'Q' || quarter(date) as quarter from daily")
    def quarter_label(spark, sf_dir):
        return daily_panel(spark, sf_dir).select("date", f.quarter_label(F.col("date")).alias("quarter")).distinct()
