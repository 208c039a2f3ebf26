"""How good a signal is: rank correlation, spreads, turnover, risk, and validation by period.

Signals come long: a row for each candidate (``by``), time and code, so any number of
candidates is measured in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.numeric import divide, finite, half_even, sortino_of_negatives, sortino_of_shortfall
from spindrift.functions.numeric import steady_round as rnd
from spindrift.operators.features import quarter_label
from spindrift.operators.selection import pick_ends

TOP, BOTTOM = 0.8, 0.2
LEAST_JOINT = 5
COST_BPS = 5.0
#: A correlation no larger than this is rounding noise around nil, not a hit.
NIL = 1e-12


def forward_return(panel: DataFrame, rows: int, wait: int = 0, order=None) -> Column:
    """From the close ``wait`` rows ahead to the close ``rows`` after that; rows of a code, whatever the dates between."""
    time = "trade_time" if "trade_time" in panel.columns else "date"
    order = order or Window.partitionBy("code").orderBy(time)
    entry = F.lead("close", wait).over(order) if wait else F.col("close")
    return finite(divide(F.lead("close", wait + rows).over(order), entry)) - 1


def section_rank(value: str, section: list[str]) -> Column:
    """Average rank within a section, divided by the number of values."""
    group = Window.partitionBy(*section)
    ordered = group.orderBy(F.col(value).asc_nulls_last())
    ties = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    average = F.rank().over(ordered) + (F.count(value).over(ties) - 1) / F.lit(2.0)
    return F.when(F.col(value).isNotNull(), average / F.count(value).over(group))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of the rows that have both; NULL below five or without spread. An aggregate."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    u, v = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(u) * F.stddev_pop(v)
    return F.when((F.count(u) >= LEAST_JOINT) & (spread > 0), divide(F.covar_pop(u, v), spread))


def section_ics(ranked: DataFrame, by: list[str], time: str, x: str = "signal_rank", y: str = "label_rank", least: int = 5) -> DataFrame:
    """A row for each section of ``least`` rows or more whose ranks correlate: ``ic``."""
    out = ranked.groupBy(*by, time).agg(correlation(x, y).alias("ic"), F.count("*").alias("n"))
    return out.where((F.col("n") >= least) & F.col("ic").isNotNull()).drop("n")


def ic_summary(ics: DataFrame, by: list[str], prefix: str = "ic") -> DataFrame:
    return ics.groupBy(*by).agg(
        F.avg("ic").alias(f"{prefix}_mean"), F.avg(F.abs("ic")).alias(f"{prefix}_abs_mean"), F.count("ic").alias(f"{prefix}_count"), F.avg((F.col("ic") > NIL).cast("double")).alias(f"{prefix}_hit_rate")
    )


def section_spreads(ranked: DataFrame, by: list[str], time: str, least: int = 5) -> DataFrame:
    """Mean label of the top fifth less that of the bottom fifth, section by section."""
    top, bottom = (F.avg(F.when(test, F.col("label"))) for test in (F.col("signal_rank") >= TOP, F.col("signal_rank") <= BOTTOM))
    out = ranked.groupBy(*by, time).agg(F.count("*").alias("n"), (top - bottom).alias("spread"))
    return out.where((F.col("n") >= least) & F.col("spread").isNotNull()).drop("n")


def spread_summary(spreads: DataFrame, by: list[str]) -> DataFrame:
    return spreads.groupBy(*by).agg(
        F.avg("spread").alias("spread_mean"), F.avg(F.abs("spread")).alias("spread_abs_mean"), F.count("spread").alias("spread_count"), F.avg((F.col("spread") > 0).cast("double")).alias("spread_hit_rate")
    )


def kept_members(members: DataFrame, by: list[str], time: str, times: DataFrame | None = None) -> DataFrame:
    """Of sets of codes at times (rows by, time, side, code): size, and how many were in the set before.

    Before means the time before in ``times`` (rows by, time), even if its set is empty;
    without ``times``, the time before that has a set of this side. Each code looks at its
    own last membership, so no set is ever gathered in one place. ``place`` counts times.
    """
    keys = [*by, "side"] if times is None else by
    listed = (members if times is None else times).select(*keys, time).distinct()
    placed = listed.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(time)) if keys else F.row_number().over(Window.orderBy(time)))
    own = Window.partitionBy(*by, "side", "code").orderBy("place")
    kept = F.lag("place").over(own) == F.col("place") - 1
    joined = members.join(placed, [*keys, time])
    return joined.withColumn("kept", kept).groupBy(*by, time, "side", "place").agg(F.count("*").alias("size"), F.count_if("kept").alias("kept"))


def turnover_of(kept: DataFrame, by: list[str], time: str) -> DataFrame:
    """A row for each time with both sides: their mean turnover, and the lower of their places."""
    share = lambda side: F.max(F.when(F.col("side") == side, 1 - F.col("kept") / F.col("size")))
    sides = kept.groupBy(*by, time).agg(share("top").alias("top"), share("bottom").alias("bottom"), F.min("place").alias("place"), F.count("*").alias("sides"))
    return sides.where("sides = 2").select(*by, time, "place", ((F.col("top") + F.col("bottom")) / 2).alias("turnover"))


def rank_sides(ranked: DataFrame, high: float = TOP, low: float = BOTTOM) -> DataFrame:
    """Rows with ``side``: rank at or above ``high`` is top, at or below ``low`` bottom."""
    sides = F.array_compact(F.array(F.when(F.col("signal_rank") >= high, "top"), F.when(F.col("signal_rank") <= low, "bottom")))
    return ranked.withColumn("side", F.explode(sides))


def rank_turnover(ranked: DataFrame, by: list[str], time: str) -> DataFrame:
    """Turnover between successive times that have any rank; none at the first."""
    valid = ranked.where("signal_rank is not null")
    kept = kept_members(rank_sides(valid).select(*by, time, "side", "code"), by, time, valid)
    return turnover_of(kept, by, time).where("place > 1")


def turnover_summary(turnover: DataFrame, by: list[str]) -> DataFrame:
    return turnover.groupBy(*by).agg(F.avg("turnover").alias("mean_one_way_turnover"), F.count("turnover").alias("turnover_count"))


def wrong_lag_signals(signals: DataFrame, by: list[str], time: str) -> DataFrame:
    """The signal of the row before and of the row after, as controls that ought to be worse."""
    order = Window.partitionBy(*by, "code").orderBy(time)
    return signals.withColumns({"signal_prev": F.lag("signal").over(order), "signal_future": F.lead("signal").over(order)})


#: Metrics of a shard that the aggregate averages.
SHARD_MEANS = ("ic_mean", "ic_abs_mean", "ic_hit_rate", "spread_mean", "spread_abs_mean", "spread_hit_rate", "wrong_lag_prev_ic_mean", "wrong_lag_future_ic_mean", "mean_one_way_turnover")


def shard_aggregate(metrics: DataFrame, by: list[str]) -> DataFrame:
    """The plain mean over shards of each shard's own metric; shards without a value don't count."""
    return metrics.groupBy(*by).agg(
        F.count("*").alias("shard_count"),
        *[F.avg(c).alias(c) for c in SHARD_MEANS if c in metrics.columns],
        F.min("signal_unique").alias("signal_unique_min"),
        F.sum("signal_nonnull").alias("signal_nonnull_sum"),
        F.sum("eval_rows").alias("eval_rows_sum"),
    )


def score_flags(aggregated: DataFrame, direction: str = "expected_direction") -> DataFrame:
    """Aligned metrics, what speaks against a candidate, and the decision."""
    out = aggregated.withColumns({"aligned_ic_mean": F.col("ic_mean") * F.col(direction), "aligned_spread_mean": F.col("spread_mean") * F.col(direction)})
    against = [
        F.when(F.col("aligned_ic_mean").isNull() | (F.col("aligned_ic_mean") <= 0), "primary_direction_not_reproduced"),
        F.when(F.abs("wrong_lag_future_ic_mean") >= F.abs("aligned_ic_mean") * 0.9, "future_signal_wrong_lag_too_strong"),
        F.when(F.col("mean_one_way_turnover") > 0.95, "extreme_minute_turnover"),
    ]
    flagged = out.withColumn("blocker_flags", F.concat_ws("|", *against))
    return flagged.withColumn("decision", F.when(F.col("blocker_flags") == "", "bl_signal_materialized_pass").otherwise("bl_signal_materialized_watch"))


def lagged_signals(signals: DataFrame, names: dict[str, str], keep: list[str], key: str = "expression_hash", time: str = "trade_time") -> DataFrame:
    """Wide signals (column: key) as rows (key, which, signal, keep ...): each as it is, a row of its code before, and a row after."""
    order = Window.partitionBy("code").orderBy(time)
    moved = signals.withColumns({f"__{kind}_{n}": move(n).over(order) for n in names for kind, move in (("prev", F.lag), ("future", F.lead))})
    rows = [F.struct(F.lit(k).alias(key), F.lit(which).alias("which"), F.col(c).alias("signal")) for n, k in names.items() for which, c in (("now", n), ("prev", f"__prev_{n}"), ("future", f"__future_{n}"))]
    return moved.select(*keep, F.inline(F.array(*rows)))


def batch_metrics(ranked: DataFrame, horizons: list[int], by: list[str], time: str = "trade_time") -> DataFrame:
    """All metrics of many signals at once, a row by (by, horizon): correlation, spread, turnover, and the controls of a wrong lag.

    ranked: rows of :func:`lagged_signals` with ``signal_rank`` by (by, which, time), and each
    horizon's label ``__r{h}`` and its rank ``__l{h}``. One aggregation takes all horizons.
    """
    section = [*by, "which", time]
    side = lambda test, h: F.avg(F.when(test, F.col(f"__r{h}")))
    per = ranked.groupBy(*section).agg(
        F.count("*").alias("n"),
        *[correlation("signal_rank", f"__l{h}").alias(f"ic{h}") for h in horizons],
        *[(side(F.col("signal_rank") >= TOP, h) - side(F.col("signal_rank") <= BOTTOM, h)).alias(f"spread{h}") for h in horizons],
    ).where("n >= 5")
    of = lambda which, c: F.when(F.col("which") == which, F.col(c))
    sums = [
        F.struct(
            F.lit(h).alias("horizon"),
            F.avg(of("now", f"ic{h}")).alias("ic_mean"),
            F.avg(F.abs(of("now", f"ic{h}"))).alias("ic_abs_mean"),
            F.avg((of("now", f"ic{h}") > NIL).cast("double")).alias("ic_hit_rate"),
            F.avg(of("now", f"spread{h}")).alias("spread_mean"),
            F.avg(F.abs(of("now", f"spread{h}"))).alias("spread_abs_mean"),
            F.avg((of("now", f"spread{h}") > 0).cast("double")).alias("spread_hit_rate"),
            F.avg(of("prev", f"ic{h}")).alias("wrong_lag_prev_ic_mean"),
            F.avg(of("future", f"ic{h}")).alias("wrong_lag_future_ic_mean"),
        )
        for h in horizons
    ]
    found = per.groupBy(*by).agg(F.array(*sums).alias("by_horizon")).select(*by, F.inline("by_horizon"))
    now = ranked.where("which = 'now'")
    counts = now.groupBy(*by).agg(F.count_distinct("signal").alias("signal_unique"), F.count("signal").alias("signal_nonnull"), F.count("*").alias("eval_rows"))
    turnover = turnover_summary(rank_turnover(now.select(*by, time, "code", "signal_rank"), by, time), by)
    return found.join(turnover, by, "left").join(counts, by)


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _cross_sums(size: int):
    """Of batches of vectors: for each two places the sums that their correlation needs, over the rows that have both."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(_SUMS), size, size))
        for batch in batches:
            values = batch.column(0)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            there = (~np.isnan(flat)).astype(float)
            x = np.nan_to_num(flat)
            total += np.stack([there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x])
        left, right = np.triu_indices(size, 1)
        columns = [pa.array(left, pa.int32()), pa.array(right, pa.int32()), *(pa.array(t[left, right]) for t in total)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *_SUMS])

    return run


def pairwise_correlation(wide: DataFrame, names: list[str]) -> DataFrame:
    """Correlation of each two columns over the rows that have both.

    Each task adds up cross products of its rows as matrices (one row for each pair of
    columns a task), and only these sums are shuffled: work grows with the rows times the
    square of the columns in matrix products, memory with the square of the columns.
    """
    return vector_correlation(wide.select(F.array(*[F.col(n).cast("double") for n in names]).alias("v")), names)


def vector_correlation(vectors: DataFrame, names: list[str]) -> DataFrame:
    """:func:`pairwise_correlation` of the places of one array column, which ``names`` name."""
    if len(names) < 2:
        return vectors.sparkSession.createDataFrame([], "left string, right string, signal_rank_corr double")
    sums = vectors.mapInArrow(_cross_sums(len(names)), "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS)).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    c = F.col
    spread = lambda s, ss: c("n") * c(ss) - c(s) * c(s)
    # Sums of equal values leave rounding errors, not nil.
    varied = lambda s, ss: spread(s, ss) > c("n") * c(ss) * 1e-12
    corr = F.when((c("n") >= LEAST_JOINT) & varied("sx", "sxx") & varied("sy", "syy"), (c("n") * c("sxy") - c("sx") * c("sy")) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy")))
    name = lambda k: F.element_at(F.array(*map(F.lit, names)), k + 1)
    return sums.select(name(c("i")).alias("left"), name(c("j")).alias("right"), corr.alias("signal_rank_corr"))


# --- daily validation


def tradable_work(panel: DataFrame, horizon: int = 1, wait: int = 1) -> DataFrame:
    """Signal rows with the return they earn and what state the code is in at entry and exit.

    The panel has ``signal`` and boolean limit_up, limit_down and suspended.
    """
    order = Window.partitionBy("code").orderBy("date")
    ahead = lambda c, n: F.coalesce(F.lead(c, n).over(order), F.lit(False)) if n else F.col(c)
    made = {"forward_return": forward_return(panel, horizon, wait), "window": quarter_label(F.col("date"))}
    for c in ("limit_up", "limit_down", "suspended"):
        made |= {f"entry_{c}": ahead(c, wait), f"exit_{c}": ahead(c, wait + horizon)}
    return panel.withColumns(made).where("signal is not null and forward_return is not null")


IC_BLOCKED = "(entry_limit_up or entry_limit_down or entry_suspended)"
LONG_BLOCKED = "(entry_limit_up or entry_suspended)"
SHORT_BLOCKED = "(entry_limit_down or entry_suspended)"


def reranked_ic(work: DataFrame, by: list[str]) -> DataFrame:
    """Rank correlation by section, ranks taken among the given rows only; five rows and two values at least."""
    sizes = Window.partitionBy(*by)
    ranked = work.withColumns({"signal_rank": section_rank("signal", by), "label_rank": section_rank("forward_return", by), "__n": F.count("*").over(sizes)})
    out = ranked.where("__n >= 5").groupBy(*by).agg(correlation("signal_rank", "label_rank").alias("rank_ic"), F.count_distinct("signal").alias("__values"))
    return out.where("__values >= 2").drop("__values")


def daily_ic_spread(work: DataFrame, share: float = 0.2) -> DataFrame:
    """By date: rank correlation, and the spread between the quantile ends."""
    day = Window.partitionBy("date")
    cut = work.withColumns({"__lo": F.percentile("signal", F.lit(share)).over(day), "__hi": F.percentile("signal", F.lit(1 - share)).over(day)})
    spread = cut.groupBy("date").agg(
        (F.avg(F.when(F.col("signal") >= F.col("__hi"), F.col("forward_return"))) - F.avg(F.when(F.col("signal") <= F.col("__lo"), F.col("forward_return")))).alias("long_short_return"),
        F.count("*").alias("__n"),
        F.count_distinct("signal").alias("__values"),
    )
    days = spread.where("__n >= 5 and __values >= 2").drop("__n", "__values")
    return days.join(reranked_ic(work, ["date"]), "date", "left").withColumn("window", quarter_label(F.col("date")))


def _pool(work: DataFrame, blocked: str, side: str, share: float) -> DataFrame:
    """The side's rows of each date whose pool is large and varied enough."""
    open_rows = work.where(f"not {blocked}")
    enough = open_rows.groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("signal").alias("v")).where("n >= 5 and v >= 2").select("date")
    return pick_ends(open_rows.join(enough, "date", "left_semi"), share).where(F.col("side") == side)


def tradable_daily(work: DataFrame, share: float = 0.2) -> DataFrame:
    """By date: rank correlation of tradable rows, long less short return, and turnover, each from its own pool."""
    days = work.groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("signal").alias("v")).where("n >= 5 and v >= 2").select("date")
    work = work.join(days, "date", "left_semi")
    sides = _pool(work, LONG_BLOCKED, "top", share).unionByName(_pool(work, SHORT_BLOCKED, "bottom", share))
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("forward_return")))
    spread = sides.groupBy("date").agg((mean("top") - mean("bottom")).alias("long_short_return"))
    turnover = turnover_of(kept_members(sides.select("date", "side", "code"), [], "date"), [], "date").where("place > 1")
    ic = reranked_ic(work.where(f"not {IC_BLOCKED}"), ["date"])
    out = days.join(ic, "date", "left").join(spread, "date", "left").join(turnover.select("date", F.col("turnover").alias("average_one_way_turnover")), "date", "left")
    return out.withColumn("window", quarter_label(F.col("date")))


def bucket_turnover(work: DataFrame, share: float = 0.2) -> DataFrame:
    """By date with five rows and two values: turnover of the top and bottom picks, no row left out."""
    days = work.groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("signal").alias("v")).where("n >= 5 and v >= 2")
    sides = pick_ends(work.join(days.select("date"), "date", "left_semi"), share)
    kept = kept_members(sides.select("date", "side", "code"), [], "date")
    value = lambda side: F.max(F.when((F.col("side") == side) & (F.col("place") > 1), 1 - F.col("kept") / F.col("size")))
    out = kept.groupBy("date").agg(F.max("size").alias("side_count"), value("top").alias("top_turnover"), value("bottom").alias("bottom_turnover"))
    return out.withColumn("average_one_way_turnover", (F.col("top_turnover") + F.col("bottom_turnover")) / 2)


def quarterly_validation(work: DataFrame, share: float = 0.2, diagnostics: dict[str, str] | None = None) -> DataFrame:
    """By quarter: days, mean rank correlation and hit rate, long and long-short returns with Sortino ratios, and what was left out.

    A date whose tradable rows are too few or too alike for a correlation has no long or
    short pool either; exit states never leave a row out.
    """
    excluded = work.groupBy("window", "date").agg(F.count_if(F.expr(IC_BLOCKED)).alias("ic_out"), F.count_if(F.expr(LONG_BLOCKED)).alias("long_out"), F.count_if(F.expr(SHORT_BLOCKED)).alias("short_out"))
    usable = work.where(f"not {IC_BLOCKED}")
    fit = usable.groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("signal").alias("v")).where("n >= 5 and v >= 2").select("date")
    ic = reranked_ic(usable, ["date"])
    on_fit = work.join(fit, "date", "left_semi")
    pools = {}
    for side, blocked in (("top", LONG_BLOCKED), ("bottom", SHORT_BLOCKED)):
        open_rows = on_fit.where(f"not {blocked}")
        sized = open_rows.groupBy("date").agg(F.count("*").alias("n")).where("n >= 5").select("date")
        pools[side] = (open_rows, sized)
    both = pools["top"][1].join(pools["bottom"][1], "date")
    picks = [pick_ends(rows.join(both, "date", "left_semi"), share).where(F.col("side") == side) for side, (rows, _) in pools.items()]
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("forward_return")))
    measured = [F.avg(F.when(F.col("side") == "top", F.col(c))).alias(f"__{name}") for c, name in (diagnostics or {}).items()]
    returns = picks[0].unionByName(picks[1]).groupBy("date").agg(mean("top").alias("long"), (mean("top") - mean("bottom")).alias("spread"), *measured)
    days = excluded.join(ic, "date", "left").join(returns, "date", "left").join(fit.withColumn("fit", F.lit(True)), "date", "left")
    return days.groupBy("window").agg(
        F.count("rank_ic").alias("trading_day_count"),
        rnd(F.avg("rank_ic")).alias("mean_rank_ic"),
        rnd(F.avg(F.when(F.col("rank_ic").isNotNull(), (F.col("rank_ic") > NIL).cast("double")))).alias("rank_ic_hit_rate"),
        rnd(F.avg("long")).alias("mean_long_return"),
        sortino_of_negatives(F.col("long")).alias("long_sortino"),
        rnd(F.avg("spread")).alias("mean_long_short_return"),
        sortino_of_negatives(F.col("spread")).alias("long_short_sortino"),
        F.sum("ic_out").alias("ic_excluded_rows"),
        F.sum(F.when(F.col("fit"), F.col("long_out")).otherwise(0)).alias("long_excluded_rows"),
        F.sum(F.when(F.col("fit"), F.col("short_out")).otherwise(0)).alias("short_excluded_rows"),
        *[rnd(F.avg(f"__{name}")).alias(f"mean_{name}") for name in (diagnostics or {}).values()],
    )


def tradability_summary(work: DataFrame) -> DataFrame:
    """How many signal rows meet a limit or a suspension at entry and at exit."""
    return work.agg(*[F.count_if(F.col(f"{when}_{c}")).alias(f"{when}_{c}_rows") for when in ("entry", "exit") for c in ("limit_up", "limit_down", "suspended")])


def capacity_diagnostics(work: DataFrame, columns: list[str], share: float = 0.2) -> DataFrame:
    """Mean of each column over a date's long picks."""
    return pick_ends(work.where(f"not {LONG_BLOCKED}"), share).where("side = 'top'").groupBy("date").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


# --- portfolios


def chronological_split(times: DataFrame, by: list[str], time: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Each time's part: the first share trains, the next validates, the rest is held out; ends rounded half to even."""
    order = Window.partitionBy(*by).orderBy(time)
    placed = times.select(*by, time).distinct().withColumns({"__at": F.row_number().over(order) - 1, "__n": F.count("*").over(Window.partitionBy(*by))})
    end = F.greatest(F.lit(1), F.least(F.col("__n"), half_even(F.col("__n") * train)))
    until = F.greatest(end, F.least(F.col("__n"), end + half_even(F.col("__n") * validation)))
    part = F.when(F.col("__at") < end, "train").when(F.col("__at") < until, "validation").otherwise("holdout")
    return placed.select(*by, time, part.alias("split"))


def audit_split(dates: DataFrame, date: str = "date") -> DataFrame:
    """Dates in three parts by rounding down: train up to 0.6, validation up to 0.8, test."""
    placed = dates.select(date).distinct().withColumns({"__at": F.row_number().over(Window.orderBy(date)) - 1})
    total = dates.select(date).distinct().count()
    part = F.when(F.col("__at") < int(total * 0.6), "train").when(F.col("__at") < int(total * 0.8), "validation").otherwise("test")
    return placed.select(date, part.alias("split"))


def portfolio_returns(ranked: DataFrame, by: list[str], time: str = "trade_time", least: int = 5, share: float = 0.2, cost_bps: float = COST_BPS, flat_cost: bool = False) -> DataFrame:
    """By candidate, horizon and time: long less short return after costs.

    Ranks come from all rows; only rows with a label trade. ``direction`` (1 or -1) is a
    column. Turnover looks at the last traded time; the first costs a full turn. With a
    flat cost every time costs a full turn and turnover isn't needed.
    """
    traded = ranked.where("signal_rank is not null and label is not null")
    sides = {"top": F.col("signal_rank") >= 1 - share, "bottom": F.col("signal_rank") <= share}
    mean = lambda side, c: F.avg(F.when(sides[side], F.col(c)))
    blocks = traded.groupBy(*by, time, "direction").agg(
        F.count("*").alias("n"), *[F.count_if(test).alias(f"{side}_count") for side, test in sides.items()], *[mean(side, "label").alias(f"{side}_mean_return") for side in sides]
    )
    blocks = blocks.where((F.col("n") >= least) & (F.col("top_count") > 0) & (F.col("bottom_count") > 0)).drop("n")
    raw = (F.col("top_mean_return") - F.col("bottom_mean_return")) * F.col("direction")
    out = blocks.withColumn("raw_return", raw)
    if flat_cost:
        return out.withColumn("trading_cost", F.lit(2.0 * cost_bps / 10000)).withColumn("net_return", F.col("raw_return") - F.col("trading_cost"))
    valid = blocks.select(*by, time)
    members = rank_sides(traded.join(valid, [*by, time], "left_semi"), 1 - share, share).select(*by, time, "side", "code")
    turnover = turnover_of(kept_members(members, by, time, valid), by, time)
    turned = out.join(turnover, [*by, time]).withColumn("one_way_turnover", F.when(F.col("place") == 1, 1.0).otherwise(F.col("turnover")))
    cost = 2.0 * cost_bps / 10000 * F.col("one_way_turnover")
    return turned.withColumn("trading_cost", cost).withColumn("net_return", F.col("raw_return") - F.col("trading_cost")).drop("place", "turnover")


def sleeve_curve(portfolio: DataFrame, by: list[str], time: str = "trade_time") -> DataFrame:
    """Equal weights: the mean over horizons (and shards) at each time."""
    return portfolio.groupBy(*by, time).agg(
        F.avg("net_return").alias("net_return"), F.avg("raw_return").alias("raw_return"), F.avg("one_way_turnover").alias("one_way_turnover"), F.count("net_return").alias("sleeve_count")
    )


def daily_returns(curve: DataFrame, by: list[str], time: str = "trade_time") -> DataFrame:
    return curve.groupBy(*by, F.to_date(time).alias("date")).agg(F.sum("net_return").alias("day_return"))


def max_drawdown(curve: DataFrame, by: list[str], time: str, value: str = "net_return") -> DataFrame:
    """The deepest fall of the compounded curve below its peak so far, a start of 1 included."""
    so_far = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    grown = curve.where(F.col(value).isNotNull()).withColumn("__equity", F.product(1 + F.col(value)).over(so_far))
    peak = F.greatest(F.max("__equity").over(so_far), F.lit(1.0))
    return grown.withColumn("__fall", F.col("__equity") / peak - 1).groupBy(*by).agg(F.least(F.min("__fall"), F.lit(0.0)).alias("max_drawdown"))


def curve_summary(curve: DataFrame, by: list[str], time: str = "trade_time") -> DataFrame:
    """Size, returns, hit rate, Sortino by time and by day, drawdown and turnover of each curve."""
    days = daily_returns(curve, by, time).groupBy(*by).agg(F.count("*").alias("day_count"), sortino_of_shortfall(F.col("day_return")).alias("day_sortino"))
    own = curve.groupBy(*by).agg(
        F.count("net_return").alias("curve_count"),
        F.avg("net_return").alias("net_mean_return"),
        F.avg("raw_return").alias("raw_mean_return"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("net_hit_rate"),
        sortino_of_shortfall(F.col("net_return")).alias("minute_sortino"),
        F.avg("one_way_turnover").alias("mean_one_way_turnover"),
    )
    return own.join(days, by).join(max_drawdown(curve, by, time), by)


def day_bootstrap(days: DataFrame, by: list[str], iterations: int = 600, seed: int = 7, value: str = "day_return", block: str | None = None) -> DataFrame:
    """Sortino ratios of resampled days: quantiles, and how often above 0.

    Days of one curve are few (one number a day), so a curve fits one task; the generator
    is CPython's, seeded. With ``block`` whole blocks (their values in order) are drawn.
    """
    import math
    import random

    import pandas as pd

    fields = ["p05", "p25", "median", "p95", "prob_gt_0"]

    def sortino(values: list[float]) -> float | None:
        shortfall = math.fsum(min(0.0, v) ** 2 for v in values) / len(values)
        return math.fsum(values) / len(values) / math.sqrt(shortfall) if shortfall > 1e-18 else None

    def quantile(ordered: list[float], q: float) -> float:
        at = (len(ordered) - 1) * q
        low, high = math.floor(at), math.ceil(at)
        return ordered[low] if low == high else ordered[low] * (high - at) + ordered[high] * (at - low)

    def resample(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order).dropna(subset=[value])
        units = [g[value].tolist() for _, g in frame.groupby(block)] if block else [[v] for v in frame[value]]
        rng = random.Random(seed)
        draws = []
        for _ in range(iterations if units else 0):
            drawn = sortino([v for _ in units for v in units[rng.randrange(len(units))]])
            if drawn is not None:
                draws.append(drawn)
        draws.sort()
        stats = [quantile(draws, q) for q in (0.05, 0.25, 0.5, 0.95)] + [sum(d > 0 for d in draws) / len(draws)] if draws else [None] * 5
        return pd.DataFrame([[*key, len(draws), *stats]], columns=[*by, "iterations", *fields])

    order = [c for c in days.columns if c not in by and c != value]
    kinds = ", ".join(f"{c} {days.schema[c].dataType.simpleString()}" for c in by)
    return days.groupBy(*by).applyInPandas(resample, f"{kinds}, iterations long, {', '.join(f'{c} double' for c in fields)}")


def train_reward(summaries: DataFrame, boots: DataFrame, inherited: DataFrame, horizons: list[int], key: str = "candidate") -> DataFrame:
    """The reward by the training part alone, and what blocks a candidate.

    summaries: rows (key, split, horizon, day_sortino, mean_one_way_turnover), horizon 0 for
    all sleeves together; boots: (key, p25, prob_gt_0) of the training part's sleeves;
    inherited: (key, inherited_blockers). Inputs are rounded to eight places first.
    """
    r8 = lambda c: half_even(c, 8)
    train = summaries.where("split = 'train'")
    whole = train.where("horizon = 0").select(key, r8(F.col("day_sortino")).alias("train_day_sortino"), r8(F.col("mean_one_way_turnover")).alias("train_turnover"))
    each = train.where(F.col("horizon").isin(horizons)).withColumn("s", r8(F.col("day_sortino")))
    spread = each.groupBy(key).agg(F.min("s").alias("train_worst"), F.percentile("s", F.lit(0.5)).alias("train_median"), F.when(F.count("s") >= 2, F.stddev_samp("s")).alias("train_stdev"))
    joined = whole.join(spread, key, "left").join(boots.select(key, r8(F.col("p25")).alias("p25"), r8(F.col("prob_gt_0")).alias("prob_gt_0")), key, "left").join(inherited, key, "left")
    blocked = F.coalesce(F.col("inherited_blockers"), F.lit("")) != ""
    turnover = F.coalesce("train_turnover", F.lit(0.0))
    or_worst = lambda c: F.coalesce(F.col(c), F.lit(-2.0))
    reward = (
        0.55 * or_worst("train_day_sortino")
        + 0.25 * or_worst("train_worst")
        + 0.20 * or_worst("p25")
        - F.greatest(turnover - 0.55, F.lit(0.0)) * 0.75
        - F.greatest(F.coalesce("train_stdev", F.lit(0.0)) - 0.50, F.lit(0.0)) * 0.25
        - F.when(blocked, 0.15).otherwise(0.0)
    )
    against = [
        F.when(F.coalesce("train_day_sortino", F.lit(-1.0)) <= 0, "non_positive_train_day_sortino"),
        F.when(F.coalesce("train_worst", F.lit(-1.0)) <= 0, "non_positive_worst_horizon_train_sortino"),
        F.when(F.coalesce("prob_gt_0", F.lit(0.0)) < 0.60, "weak_train_day_mcmc"),
        F.when(turnover > 0.75, "extreme_turnover"),
        F.when(blocked, "inherited_search_blocker"),
    ]
    out = joined.withColumns({"train_reward": half_even(reward, 8), "train_reward_blockers": F.concat_ws("|", *against)})
    return out.withColumn("train_reward_decision", F.when(F.col("train_reward_blockers") == "", "TRAIN_REWARD_FOLLOWUP_READY").otherwise("HOLD_TRAIN_REWARD"))


# --- audits


def exposures(panel: DataFrame, signal: str, controls: list[str]) -> DataFrame:
    """By date and control: rank correlation with the signal over rows that have both."""
    long = panel.select("date", "code", F.col(signal).alias("signal"), F.inline(F.array(*[F.struct(F.lit(c).alias("control"), F.col(c).alias("forward_return")) for c in controls])))
    return reranked_ic(long.where("signal is not null and forward_return is not null"), ["date", "control"]).withColumnRenamed("rank_ic", "exposure")


def residualize(panel: DataFrame, signal: str, controls: list[str]) -> DataFrame:
    """The signal with one control after the other taken out, date by date."""
    from spindrift.plans.compiler import evaluate

    out = panel.withColumn("__left", F.col(signal))
    for c in controls:
        out = evaluate(out, {"__left": f"CSResidual($__left,${c})"})
    return out.withColumnRenamed("__left", f"{signal}_residual")


def group_demean(panel: DataFrame, signal: str, group: str, least: int = 3) -> DataFrame:
    """The signal less its group's mean on the date; NULL in groups of fewer values."""
    w = Window.partitionBy("date", group)
    return panel.withColumn(f"{signal}_neutral", F.when(F.count(signal).over(w) >= least, F.col(signal) - F.avg(signal).over(w)))


def net_spreads(daily: DataFrame, by: list[str], cost_bps: float = 10.0) -> DataFrame:
    """Means over dates, with the spread after what turnover costs; a date without turnover costs nothing."""
    net = F.col("long_short_return") - F.coalesce("average_one_way_turnover", F.lit(0.0)) * cost_bps / 10000
    return daily.groupBy(*by).agg(
        rnd(F.avg("rank_ic")).alias("mean_rank_ic"), rnd(F.avg("long_short_return")).alias("mean_spread"), rnd(F.avg(net)).alias("mean_net_spread"), rnd(F.avg("average_one_way_turnover")).alias("mean_turnover")
    )


def watchlist(signals: DataFrame, k: int) -> DataFrame:
    """The latest date's ranks and its first and last ``k`` codes."""
    latest = signals.agg(F.max("date")).first()[0]
    today = signals.where((F.col("date") == F.lit(latest).cast("date")) & F.col("signal").isNotNull()).withColumn("rank_pct", section_rank("signal", ["date"]))
    high, low = (F.row_number().over(Window.partitionBy("date").orderBy(o, "code")) for o in (F.desc("signal"), F.col("signal")))
    placed = today.withColumns({"__hi": high, "__lo": low})
    side = F.array_compact(F.array(F.when(F.col("__hi") <= k, "top"), F.when(F.col("__lo") <= k, "bottom")))
    return placed.withColumn("side", F.explode(side)).drop("__hi", "__lo")
