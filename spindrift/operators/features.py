"""Columns derived from a panel: returns, limit events, trend and market states, codes and clocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.numeric import as_number, divide
from spindrift.functions.numeric import steady_round as rnd

# Return windows by column name, thresholds, and the fields that a signal's clock makes late.
RETURN_WINDOWS = {"ret": 1, "reta": 1, "retb": 2, "retc": 3, "retd": 5, "rete": 10, "retf": 20, "amtm": 20}
LIMIT_RATIO, LIMIT_PCT, TOLERANCE = 0.098, 9.8, 1e-6
POST_HIGH_DAYS = (1, 2, 3, 5)
UP_FLAGS = ("is_limit_up", "limitup", "limit_up", "up_limit")
DOWN_FLAGS = ("is_limit_down", "limitdown", "limit_down", "down_limit")
OPEN_FIELDS = ("open", "overnight", "limit_up_open_event", "limit_down_open_event")
DAY_FIELDS = (
    "high low close amount volume vwap turnover_rate turnover_ratio turnover_ratio_real ret daily_ret amtm reta retb retc retd rete retf return_1d return_5d return_20d"
    " rps_rank rps_score rps_slope_3d"
).split()
CLOCKS = ("after_close", "pre_open", "after_open")

def by_code():
    """The rows of a code in order of date."""
    return Window.partitionBy("code").orderBy("date")


def clock_lags(clock: str) -> dict[str, int]:
    """Rows by which fields are late for a signal formed at this time of day."""
    if clock not in CLOCKS:
        raise ValueError(f"unsupported_signal_clock:{clock}")
    if clock == "after_close":
        return {}
    late = [*DAY_FIELDS, *OPEN_FIELDS] if clock == "pre_open" else DAY_FIELDS
    return dict.fromkeys(late, 1)


def change(column: str, rows: int, order=None) -> Column:
    """The relative change over so many rows."""
    return divide(F.col(column), F.lag(column, rows).over(order or by_code())) - 1


def add_absent(panel: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return panel.withColumns({name: value for name, value in columns.items() if name not in panel.columns})


def augment_returns(panel: DataFrame) -> DataFrame:
    """Average price, returns and a suspension flag, where the panel lacks them."""
    made = {"vwap": divide(F.col("amount"), F.col("volume"))}
    made |= {name: change("close", rows) for name, rows in RETURN_WINDOWS.items()}
    return add_absent(panel, made | {"susp": F.lit(0.0)})


def augment_turnover(panel: DataFrame) -> DataFrame:
    """Volume over the float, or over its own mean of the last 20 rows (five at least)."""
    if "float_share" in panel.columns:
        return add_absent(panel, {"turnover_rate": divide(F.col("volume"), F.col("float_share"))})
    frame = by_code().rowsBetween(-19, 0)
    usual = F.when(F.count("volume").over(frame) >= 5, F.avg("volume").over(frame))
    return add_absent(panel, {"turnover_rate": divide(F.col("volume"), usual)})


def usable_columns(panel: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Which of the columns hold any number at all; found in one pass over them."""
    there = [n for n in names if n in panel.columns]
    if not there:
        return []
    row = panel.agg(*[F.count(as_number(F.col(n))).alias(n) for n in there]).first()
    return [n for n in there if row[n] > 0]


def limit_flags(panel: DataFrame) -> tuple[Column, Column]:
    """(up, down): the vendor's status if it says anything, else the first usable flag column, else the day's change."""
    usable = usable_columns(panel, ("tdxgp_limit_status", *UP_FLAGS, *DOWN_FLAGS))
    if "tdxgp_limit_status" in usable:
        status = as_number(F.col("tdxgp_limit_status"))
        return F.coalesce(status == 2.0, F.lit(False)), F.coalesce(status == -2.0, F.lit(False))
    up, down = (next((n for n in names if n in usable), None) for names in (UP_FLAGS, DOWN_FLAGS))
    if up is None and down is None and "rt_change_pct" in panel.columns:
        move = as_number(F.col("rt_change_pct"))
        return F.coalesce(move >= LIMIT_PCT, F.lit(False)), F.coalesce(move <= -LIMIT_PCT, F.lit(False))
    return tuple(F.coalesce(as_number(F.col(n)) > 0, F.lit(False)) if n else F.lit(False) for n in (up, down))


def streaks(panel: DataFrame, masks: dict[str, Column], order=None) -> DataFrame:
    """For each boolean column made: how many rows in a row it has been true, 0 where it isn't."""
    order = order or by_code()
    places = {f"__{n}_at": F.when(~F.coalesce(m, F.lit(False)), F.row_number().over(order)) for n, m in masks.items()}
    out = panel.withColumns(places)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = {n: (F.row_number().over(order) - F.coalesce(F.max(f"__{n}_at").over(so_far), F.lit(0))).cast("double") for n in masks}
    return out.withColumns(counted).drop(*places)


def limit_streaks(panel: DataFrame) -> DataFrame:
    """Limit events of the validator's cascade, their streaks, breaks and flips."""
    up, down = limit_flags(panel)
    out = panel.withColumns({"limit_up_event": up.cast("double"), "limit_down_event": down.cast("double")})
    out = streaks(out, {"limit_up_streak": F.col("limit_up_event") > 0, "limit_down_streak": F.col("limit_down_event") > 0})
    before = {d: F.coalesce(F.lag(f"limit_{d}_event").over(by_code()), F.lit(0.0)) > 0 for d in ("up", "down")}
    now = {d: F.col(f"limit_{d}_event") > 0 for d in ("up", "down")}
    return out.withColumns(
        {
            "limit_up_break": (before["up"] & ~now["up"]).cast("double"),
            "limit_down_repair": (before["down"] & ~now["down"]).cast("double"),
            "limit_flip_up_to_down": (before["up"] & now["down"]).cast("double"),
            "limit_flip_down_to_up": (before["down"] & now["up"]).cast("double"),
        }
    )


def _closed_at_limit(panel: DataFrame, up: bool) -> Column:
    """The event layer's own cascade: a status column counts merely by being there."""
    if "tdxgp_limit_status" in panel.columns:
        return as_number(F.col("tdxgp_limit_status")) == (2.0 if up else -2.0)
    flags = usable_columns(panel, UP_FLAGS if up else DOWN_FLAGS)
    if flags:
        return F.coalesce(as_number(F.col(flags[0])), F.lit(0.0)) != 0.0
    if "rt_change_pct" in panel.columns:
        move = as_number(F.col("rt_change_pct"))
        return move >= LIMIT_RATIO * 100 if up else move <= -LIMIT_RATIO * 100
    move = divide(F.col("close"), F.col("event_prev_close")) - 1
    return move >= LIMIT_RATIO if up else move <= -LIMIT_RATIO


def _touched(panel: DataFrame, price: str, up: bool) -> Column:
    """Whether a price reached the limit: the exact limit price if known, else a ratio to the last close."""
    exact = next((c for c in (("up_limit_price", "limit_up_price") if up else ("down_limit_price", "limit_down_price")) if c in panel.columns), None)
    if exact:
        limit = as_number(F.col(exact))
        return F.col(price) >= limit - TOLERANCE if up else F.col(price) <= limit + TOLERANCE
    move = divide(F.col(price), F.col("event_prev_close")) - 1
    return move >= LIMIT_RATIO - TOLERANCE if up else move <= -LIMIT_RATIO + TOLERANCE


def event_features(panel: DataFrame, longest: int = 10) -> DataFrame:
    """Limit events at close, open and touch, what follows from them, and the market's highest streak."""
    out = panel.withColumn("event_prev_close", F.lag("close").over(by_code()))
    marks: dict[str, Column] = {}
    for side, low_or_high in (("up", "high"), ("down", "low")):
        up = side == "up"
        touch = F.coalesce(_touched(out, low_or_high, up), F.lit(False))
        if "tdxgp_limit_status" in out.columns:
            status = as_number(F.col("tdxgp_limit_status"))
            touch = touch | F.coalesce(status >= 1.0 if up else status <= -1.0, F.lit(False))
        marks[f"__{side}_close"] = F.coalesce(_closed_at_limit(out, up), F.lit(False))
        marks[f"__{side}_open"] = F.coalesce(_touched(out, "open", up), F.lit(False))
        marks[f"__{side}_touch"] = touch
    out = out.withColumns(marks)
    out = streaks(out, {f"limit_{s}_streak_{kind}": F.col(f"__{s}_{kind}") for s in ("up", "down") for kind in ("close", "touch")})
    first: dict[str, Column] = {}
    for s in ("up", "down"):
        close, opened, touch = (F.col(f"__{s}_{k}") for k in ("close", "open", "touch"))
        first |= {
            f"limit_{s}_close_event": close.cast("double"),
            f"limit_{s}_event": close.cast("double"),
            f"limit_{s}_open_event": opened.cast("double"),
            f"limit_{s}_touch_event": touch.cast("double"),
            f"limit_{s}_touch_not_close": (touch & ~close).cast("double"),
            f"limit_{s}_open_not_close": (opened & ~close).cast("double"),
            f"limit_{s}_close_not_open": (close & ~opened).cast("double"),
            f"limit_{s}_streak": F.col(f"limit_{s}_streak_close"),
            f"__{s}_before": F.coalesce(F.lag(f"limit_{s}_streak_close").over(by_code()), F.lit(0.0)),
        }
    day = Window.partitionBy("date")
    first["market_high_board"] = F.max("limit_up_streak_close").over(day)
    first["high_board_rank"] = F.dense_rank().over(day.orderBy(F.desc("limit_up_streak_close"))).cast("double")
    out = out.withColumns(first)
    streak, high = F.col("limit_up_streak_close"), F.col("market_high_board")
    up, down, was_up, was_down = (F.col(c) for c in ("__up_close", "__down_close", "__up_before", "__down_before"))
    out = out.withColumns(
        {
            "limit_up_break": ((was_up > 0) & ~up).cast("double"),
            "limit_down_repair": ((was_down > 0) & ~down).cast("double"),
            "limit_flip_up_to_down": ((was_up > 0) & down).cast("double"),
            "limit_flip_down_to_up": ((was_down > 0) & up).cast("double"),
            "is_market_high_board": ((streak > 0) & (streak == high)).cast("double"),
            "streak_gap_to_market_high": F.greatest(high - streak, F.lit(0.0)),
        }
    )
    last: dict[str, Column] = {}
    for n in range(1, longest + 1):
        for s in ("up", "down"):
            last[f"limit_{s}_streak_ge_{n}"] = (F.col(f"limit_{s}_streak_close") >= n).cast("double")
            last[f"limit_{s}_touch_streak_ge_{n}"] = (F.col(f"limit_{s}_streak_touch") >= n).cast("double")
        last[f"break_board_after_streak_ge_{n}"] = ((was_up >= n) & ~up).cast("double")
        last[f"limit_down_rebound_after_streak_ge_{n}"] = ((was_down >= n) & ~down).cast("double")
    for days in POST_HIGH_DAYS:
        was_high = F.coalesce(F.lag("is_market_high_board", days).over(by_code()), F.lit(0.0)) > 0
        last[f"post_market_high_board_tplus_{days}"] = was_high.cast("double")
        last[f"break_after_high_board_tplus_{days}"] = (was_high & (F.col("limit_up_break") > 0)).cast("double")
    return out.withColumns(last).drop(*marks, "__up_before", "__down_before")


#: The daily counts' sources by the name that stands for them.
COUNTED_EVENTS = {
    "close": "limit_up_close_event",
    "open": "limit_up_open_event",
    "touch": "limit_up_touch_event",
    "open_not_close": "limit_up_open_not_close",
    "touch_not_close": "limit_up_touch_not_close",
    "close_not_open": "limit_up_close_not_open",
}


def event_window_counts(events: DataFrame, longest: int = 10) -> DataFrame:
    """How often each event happened in the last 2, 3, ... rows; short histories count what they have."""
    made: dict[str, Column] = {}
    for n in range(2, longest + 1):
        for name, source in COUNTED_EVENTS.items():
            made[f"limit_up_{name}_count_t{n}"] = F.sum(F.coalesce(source, F.lit(0.0))).over(by_code().rowsBetween(-(n - 1), 0))
    out = events.withColumns(made)
    return out.withColumns(
        {f"limit_up_any_{k}_in_t{n}": (F.col(f"limit_up_{k}_count_t{n}") > 0).cast("double") for n in range(2, longest + 1) for k in ("open_not_close", "close_not_open")}
    )


def feature_coverage(panel: DataFrame, fields: list[str]) -> DataFrame:
    """For each field: whether it is there, and the shares of rows that have it and have it above 0."""
    there = [f for f in fields if f in panel.columns]
    parts = [F.struct(F.lit(f).alias("field"), F.count(F.col(f)).alias("n"), F.count_if(F.col(f) > 0).alias("k")) for f in there]
    absent = [F.struct(F.lit(f).alias("field"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("k")) for f in fields if f not in there]
    row = panel.agg(F.count("*").alias("rows"), F.array(*parts, *absent).alias("x"))
    ratio = lambda c: rnd(F.coalesce(divide(F.col(c), F.col("rows")), F.lit(0.0)), 6)
    return row.select("rows", F.inline("x")).select("field", F.col("n").isNotNull().alias("present"), ratio("n").alias("non_null_ratio"), ratio("k").alias("positive_ratio"))


@dataclass(frozen=True)
class TrendSettings:
    """Windows, least rows, and the thresholds between states."""

    window: int = 20
    short: int = 5
    least: int = 8
    up: float = 0.0015
    down: float = -0.0010


def threshold_state(value: Column, up: float, down: float) -> Column:
    """1, -1 or 0; NULL stays NULL."""
    return F.when(value <= down, -1.0).when(value >= up, 1.0).when(value.isNotNull(), 0.0)


def _rolling(value: str | Column, order, rows: int, least: int, aggregate=F.avg) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    frame = order.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(frame) >= least, aggregate(column).over(frame))


def trend_state(panel: DataFrame, settings: TrendSettings = TrendSettings()) -> DataFrame:
    """Trend of each stock and of the market as of each row's own date; nothing later is read."""
    s = settings
    work = panel.where("date is not null and code is not null and close is not null").withColumn("__ret", change("close", 1))
    work = work.withColumns(
        {
            "stock_trend_eff": _rolling("__ret", by_code(), s.window, min(s.least, s.window)),
            "__short": _rolling("__ret", by_code(), s.short, min(s.least, s.short)),
            "__high": _rolling(F.coalesce("high", "close"), by_code(), s.window, min(s.least, s.window), F.max),
            "__low": _rolling(F.coalesce("low", "close"), by_code(), s.window, min(s.least, s.window), F.min),
        }
    )
    work = work.withColumns(
        {
            "stock_trend_slope": F.col("__short") - F.col("stock_trend_eff"),
            "stock_trend_state": threshold_state(F.col("stock_trend_eff"), s.up, s.down),
            "stock_price_position_state": divide(F.col("close") - F.col("__low"), F.col("__high") - F.col("__low")),
        }
    )
    daily = work.groupBy("date").agg(F.avg("__ret").alias("ew"), F.avg(F.when(F.col("__ret") > 0, 1.0).otherwise(0.0)).alias("up"))
    by_date = Window.orderBy("date")  # one row for each date
    daily = daily.select(
        "date",
        _rolling("ew", by_date, s.window, s.least).alias("market_trend_eff"),
        _rolling("up", by_date, s.window, s.least).alias("market_breadth_state"),
        _rolling("ew", by_date, s.window, s.least, F.stddev_pop).alias("market_vol_state"),
    ).withColumn("market_trend_state", threshold_state(F.col("market_trend_eff"), s.up, s.down))
    return work.drop("__ret", "__short", "__high", "__low").join(daily, "date", "left")


@dataclass(frozen=True)
class RegimeSettings:
    window: int = 20
    least: int = 8
    liquidity_short: int = 20
    liquidity_long: int = 60
    liquidity_least: int = 20
    density_window: int = 5
    density_least: int = 2
    uptrend: float = 0.0015
    drawdown: float = -0.0010
    high_volatility: float = 0.018
    contraction: float = 0.75
    density: float = 0.001


def market_regime(panel: DataFrame, settings: RegimeSettings = RegimeSettings()) -> DataFrame:
    """A row for each date: the market's return, breadth, size, and a label from what was known the date before."""
    s = settings
    work = panel.where("date is not null and code is not null and close is not null").withColumn("__ret", change("close", 1))
    ratio = lambda test: divide(F.count_if(test), F.count("rt_change_pct"))
    daily = work.groupBy("date").agg(
        F.avg("__ret").alias("ew_return"),
        divide(F.count_if(F.col("__ret") > 0), F.count("__ret")).alias("up_ratio"),
        F.count_distinct("code").alias("instrument_count"),
        F.sum("amount").alias("amount_sum"),
        ratio(F.col("rt_change_pct") >= LIMIT_PCT).alias("limit_up_ratio"),
        ratio(F.col("rt_change_pct") <= -LIMIT_PCT).alias("limit_down_ratio"),
    )
    by_date = Window.orderBy("date")  # one row for each date
    density = F.coalesce("limit_up_ratio", F.lit(0.0)) + F.coalesce("limit_down_ratio", F.lit(0.0))
    rolled = daily.withColumns(
        {
            "__trend": _rolling("ew_return", by_date, s.window, s.least),
            "__vol": _rolling("ew_return", by_date, s.window, s.least, F.stddev_pop),
            "__liq": divide(_rolling("amount_sum", by_date, s.liquidity_short, s.least), _rolling("amount_sum", by_date, s.liquidity_long, s.liquidity_least)),
            "__density": _rolling(density, by_date, s.density_window, s.density_least),
        }
    )
    lagged = {"trend_mean_lag1": "__trend", "volatility_lag1": "__vol", "liquidity_ratio_lag1": "__liq", "limit_density_lag1": "__density"}
    out = rolled.withColumns({name: F.lag(of).over(by_date) for name, of in lagged.items()}).drop(*lagged.values())
    label = (
        F.when(F.col("trend_mean_lag1").isNull() | F.col("volatility_lag1").isNull(), "unknown_warmup")
        .when(F.col("limit_density_lag1") >= s.density, "limit_density_high")
        .when(F.col("liquidity_ratio_lag1") < s.contraction, "liquidity_contraction")
        .when(F.col("trend_mean_lag1") >= s.uptrend, "strong_uptrend")
        .when(F.col("trend_mean_lag1") <= s.drawdown, "drawdown")
        .when(F.col("volatility_lag1") >= s.high_volatility, "high_vol_sideways")
        .otherwise("sideways_or_rotation")
    )
    return out.withColumn("pit_regime_label", label)


def regime_coverage(regimes: DataFrame) -> DataFrame:
    mean = lambda c, name: rnd(F.avg(c), 6).alias(name)
    return regimes.groupBy("pit_regime_label").agg(
        F.count("*").alias("days"),
        mean("ew_return", "mean_ew_return"),
        mean("up_ratio", "mean_up_ratio"),
        mean("liquidity_ratio_lag1", "mean_liquidity_ratio"),
        mean("limit_density_lag1", "mean_limit_density"),
    )


def open_gap(minutes: DataFrame) -> DataFrame:
    """Each minute row with its day's first open over the last close of the code's day before, less 1."""
    days = minutes.groupBy("code", "date").agg(F.min_by("open", "trade_time").alias("first_open"), F.max_by("close", "trade_time").alias("last_close"))
    gaps = days.select("code", "date", (divide(F.col("first_open"), F.lag("last_close").over(by_code())) - 1).alias("open_gap"))
    return minutes.join(gaps, ["code", "date"], "left")


#: Fixed: ratios of statement items, (above, below) the line.
FUND_RATIOS = {
    "ctx_fund_ps_operate_profit_margin": ("OPERATE_PROFIT", "OPERATE_INCOME"),
    "ctx_fund_ps_netprofit_margin": ("NETPROFIT", "OPERATE_INCOME"),
    "ctx_fund_ps_research_to_income": ("RESEARCH_EXPENSE", "OPERATE_INCOME"),
    "ctx_fund_bs_cash_to_assets": ("MONETARYFUNDS", "TOTAL_ASSETS"),
    "ctx_fund_bs_debt_to_assets": ("TOTAL_LIABILITIES", "TOTAL_ASSETS"),
    "fund_current_ratio": ("TOTAL_CURRENT_ASSETS", "TOTAL_CURRENT_LIAB"),
    "ctx_fund_bs_goodwill_to_assets": ("GOODWILL", "TOTAL_ASSETS"),
    "ctx_fund_bs_inventory_to_assets": ("INVENTORY", "TOTAL_ASSETS"),
    "ctx_fund_cf_operate_cash_to_netprofit": ("NETCASH_OPERATE", "NETPROFIT"),
    "fund_ocf_to_assets": ("NETCASH_OPERATE", "TOTAL_ASSETS"),
}
#: Fixed: statement items that are passed on as they are.
FUND_ITEMS = {
    "ctx_fund_cf_end_cce": "END_CCE",
    "ctx_fund_cf_netcash_finance": "NETCASH_FINANCE",
    "ctx_fund_cf_netcash_invest": "NETCASH_INVEST",
    "ctx_fund_cf_total_operate_inflow": "TOTAL_OPERATE_INFLOW",
    "ctx_fund_cf_total_operate_outflow": "TOTAL_OPERATE_OUTFLOW",
}


def fund_ratios(statements: DataFrame) -> DataFrame:
    """The ratios and items whose inputs the statements have."""
    there = set(statements.columns)
    made = {n: divide(as_number(F.col(a)), as_number(F.col(b))) for n, (a, b) in FUND_RATIOS.items() if {a, b} <= there}
    return statements.withColumns(made | {n: as_number(F.col(c)) for n, c in FUND_ITEMS.items() if c in there})


NO_CODE = ("NAN", "NONE", "NULL", "")


def _exchange(digits: Column, rules: dict[str, str], otherwise: Column) -> Column:
    """Six digits with the exchange that their start stands for."""
    out = None
    for pattern, exchange in rules.items():
        test, value = digits.rlike(f"^({pattern})"), F.concat(digits, F.lit(f".{exchange}"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def normalize_code(code: Column, rules: str = "event") -> Column:
    """An instrument's code as six digits and exchange.

    Three sources write codes by rules of their own, so there are three: ``event`` (a given
    suffix wins; too short: empty), ``adapter`` (suffix ignored; too short: as it is) and
    ``daily`` (a given suffix wins; exchange by two digits; none: the digits alone).
    """
    text = F.upper(F.trim(F.coalesce(code.cast("string"), F.lit(""))))
    first, rest = F.substring_index(text, ".", 1), F.expr("'x'")
    rest = F.when(F.instr(text, ".") > 0, F.substr(text, F.instr(text, ".") + 1)).otherwise(F.lit(""))
    all_digits, own_digits, letters = F.regexp_replace(text, r"\D", ""), F.regexp_replace(first, r"\D", ""), F.regexp_replace(rest, "[^A-Z]", "")
    one_digit = {"0|2|3": "SZ", "4|8|9": "BJ"}
    if rules == "event":
        last = F.right(all_digits, F.lit(6))
        plain = F.when(F.length(all_digits) < 6, "").otherwise(_exchange(last, one_digit, F.concat(last, F.lit(".SH"))))
        given = F.concat(F.lpad(F.right(own_digits, F.lit(6)), 6, "0"), F.lit("."), F.left(letters, F.lit(2)))
        return F.when(text.isin(*NO_CODE), "").when((own_digits != "") & (letters != ""), given).otherwise(plain)
    if rules == "adapter":
        last = F.right(own_digits, F.lit(6))
        return F.when(text.isin(*NO_CODE), "").when(F.length(own_digits) >= 6, _exchange(last, one_digit, F.concat(last, F.lit(".SH")))).otherwise(text)
    if rules == "daily":
        last = F.right(all_digits, F.lit(6))
        padded = F.when(F.length(own_digits) >= 6, own_digits).otherwise(F.lpad(own_digits, 6, "0"))
        two = {"60|68|90|51|52|56|58": "SH", "00|30|15|16|18|39": "SZ", "43|83|87|88|92": "BJ"}
        plain = F.when(F.length(all_digits) < 6, text).otherwise(_exchange(last, two, last))
        given = F.when((own_digits != "") & (letters != ""), F.concat(padded, F.lit("."), letters)).otherwise(text)
        return F.when(F.instr(text, ".") > 0, given).otherwise(plain)
    raise ValueError(f"unknown rules: {rules}")


def parse_cutoff(text: Column) -> Column:
    """Minutes of the day in the first time of a text (9:31, 0931, 14：05)."""
    clean = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    pattern = "([01]?[0-9]|2[0-3])[:：]?([0-5][0-9])"
    hours, minutes = (F.regexp_extract(clean, pattern, k).try_cast("int") for k in (1, 2))
    return F.when(~F.lower(clean).isin("", "nan", "none", "null", "--"), (hours * 60 + minutes).cast("double"))


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def truthy(flag: Column) -> Column:
    """1 for the ways in which sources say yes, else 0."""
    text = F.lower(F.trim(F.coalesce(flag.cast("string"), F.lit(""))))
    return F.when(text.isin("1", "1.0", "true", "yes", "y", "涨停", "是"), 1.0).otherwise(0.0)
