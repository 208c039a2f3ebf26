"""Signal metrics over the minute and daily panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.catalog import Catalog
from spindrift.functions.numeric import steady_round as rnd
from spindrift.catalog.panels_sql import DAILY, MINUTE
from spindrift.catalog.selection import SIGNAL, signals
from spindrift.functions.numeric import sortino_of_negatives, sortino_of_shortfall
from spindrift.operators import metrics as m
from spindrift.plans.compiler import evaluate
from spindrift.sources.panels import daily_panel, minute_panel

FORMULAS = {"flow": "Div($gappy,$volume)", "move": "Delta($close,2)", "errors": "Mean($error_count,4)"}
HORIZONS = (1, 5)
BY = ["candidate", "horizon", "shard_index"]

LONG = """
sg as (select *, gappy / nullif(volume, 0) as flow, close - lag(close, 2) over t as move, case when count(error_count) over w >= 4 then avg(error_count) over w end as errors,
  lead(close, 1) over t / nullif(close, 0) - 1 as r1, lead(close, 5) over t / nullif(close, 0) - 1 as r5 from minute
  window t as (partition by code order by trade_time), w as (partition by code order by trade_time rows between 3 preceding and current row)),
lg as (select code, trade_time, shard_index, c.candidate, case c.candidate when 'flow' then flow when 'move' then move else errors end as signal, h.horizon, case h.horizon when 1 then r1 else r5 end as label
  from sg, (values ('flow'), ('move'), ('errors')) c(candidate), (values (1), (5)) h(horizon))"""


def rank_sql(column: str, part: str) -> str:
    return f"case when {column} is not null then (rank() over (partition by {part} order by {column} nulls last) + (count({column}) over (partition by {part}, {column}) - 1) / 2.0) / count({column}) over (partition by {part}) end"


SECTION = "candidate, horizon, shard_index, trade_time"
RANKED = f"rk as (select *, {rank_sql('signal', SECTION)} as sr, {rank_sql('label', SECTION)} as lr from lg)"
ALL = f"{DAILY}".strip()


def corr_sql(x: str, y: str) -> str:
    u, v = f"case when {x} is not null and {y} is not null then {x} end", f"case when {x} is not null and {y} is not null then {y} end"
    return f"case when count({u}) >= 5 and stddev_pop({u}) * stddev_pop({v}) > 0 then covar_pop({u}, {v}) / (stddev_pop({u}) * stddev_pop({v})) end"


ICS = f"ics as (select candidate, horizon, shard_index, trade_time, {corr_sql('sr', 'lr')} as ic, count(*) as n from rk group by all)"


def long_signals(spark, sf_dir):
    """Rows for each candidate and horizon: signal and label, ranked within the shard's section."""
    minutes = evaluate(minute_panel(spark, sf_dir), FORMULAS)
    minutes = minutes.withColumns({f"r{h}": m.forward_return(minutes, h) for h in HORIZONS})
    pairs = [F.struct(F.lit(c).alias("candidate"), F.col(c).alias("signal"), F.lit(h).alias("horizon"), F.col(f"r{h}").alias("label")) for c in FORMULAS for h in HORIZONS]
    return minutes.select("code", "trade_time", "shard_index", F.inline(F.array(*pairs)))


def ranked(spark, sf_dir, section=(*BY, "trade_time")):
    out = long_signals(spark, sf_dir)
    return out.withColumns({"signal_rank": m.section_rank("signal", list(section)), "label_rank": m.section_rank("label", list(section))})


def _rounded(df, keys, digits=6):
    return df.select(*keys, *[rnd(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


#: The daily test signal with limit flags, and what it earns.
WORK = f"""wk0 as (select code, date, code_no, amount, volume, gappy / nullif(volume, 0) as signal, close / nullif(lag(close) over t, 0) - 1 > 1.5 as limit_up, close / nullif(lag(close) over t, 0) - 1 < -0.7 as limit_down,
    (code_no + month(date)) % 17 = 3 as suspended, lead(close, 2) over t / nullif(lead(close, 1) over t, 0) - 1 as forward_return from daily window t as (partition by code order by date)),
  wk1 as (select *, {", ".join(f"coalesce(lead(coalesce({c}, false), {n}) over (partition by code order by date), false) as {w}_{c}" for c in ("limit_up", "limit_down", "suspended") for w, n in (("entry", 1), ("exit", 2)))} from wk0),
  wk as (select *, year(date) || 'Q' || quarter(date) as window_ from wk1 where signal is not null and forward_return is not null)"""


def work(spark, sf_dir):
    panel = evaluate(daily_panel(spark, sf_dir), {"signal": "Div($gappy,$volume)", "move": "Mom($close,1)"})
    flags = {
        "limit_up": F.coalesce(F.col("move") > 1.5, F.lit(False)),
        "limit_down": F.coalesce(F.col("move") < -0.7, F.lit(False)),
        "suspended": (F.col("code_no") + F.month("date")) % 17 == 3,
    }
    return m.tradable_work(panel.withColumns(flags), 1, 1)


def reranked_sql(source: str, keys: str = "date") -> str:
    inner = f"select *, {rank_sql('signal', keys)} as sr, {rank_sql('forward_return', keys)} as lr from {source}"
    return f"select {keys}, {corr_sql('sr', 'lr')} as rank_ic from ({inner}) group by {keys} having count(*) >= 5 and count(distinct signal) >= 2"


SORTINO = "case when count(*) filter ({0} < 0) = 0 then avg({0}) else avg({0}) / nullif(stddev_pop(case when {0} < 0 then {0} end), 0) * sqrt(count({0})) end"
SHORTFALL = "case when avg(pow(least({0}, 0.0), 2)) > 1e-18 then avg({0}) / sqrt(avg(pow(least({0}, 0.0), 2))) end"

PORT_BY = "candidate, horizon, shard_index"
PORT = f"""tr as (select *, case candidate when 'move' then -1.0 else 1.0 end as direction from rk where sr is not null and label is not null),
bl as (select {PORT_BY}, trade_time, direction, count(*) filter (sr >= 1 - 0.2::double) as top_count, count(*) filter (sr <= 0.2) as bottom_count, avg(case when sr >= 1 - 0.2::double then label end) as top_mean_return,
  avg(case when sr <= 0.2 then label end) as bottom_mean_return, row_number() over (partition by {PORT_BY} order by trade_time) as place from tr group by {PORT_BY}, trade_time, direction
  having count(*) >= 2 and count(*) filter (sr >= 1 - 0.2::double) > 0 and count(*) filter (sr <= 0.2) > 0),
mb as (select tr.candidate, tr.horizon, tr.shard_index, tr.trade_time, code, place, s.side from tr join bl using ({PORT_BY}, trade_time), (values ('top'), ('bottom')) s(side) where (side = 'top' and sr >= 1 - 0.2::double) or (side = 'bottom' and sr <= 0.2)),
kp as (select *, lag(place) over (partition by {PORT_BY}, side, code order by place) = place - 1 as kept from mb),
tn as (select {PORT_BY}, trade_time, avg(1 - k / n::double) as turnover from (select {PORT_BY}, trade_time, side, count(*) as n, count(*) filter (kept) as k from kp group by all) group by {PORT_BY}, trade_time),
pf as (select bl.*, (top_mean_return - bottom_mean_return) * direction as raw_return, case when place = 1 then 1.0 else turnover end as one_way_turnover from bl join tn using ({PORT_BY}, trade_time)),
pn as (select *, 0.001::double * one_way_turnover as trading_cost, raw_return - 0.001::double * one_way_turnover as net_return from pf),
cv as (select candidate, trade_time, avg(net_return) as net_return, avg(raw_return) as raw_return, avg(one_way_turnover) as one_way_turnover, count(net_return) as sleeve_count from pn group by 1, 2)"""


def portfolio(spark, sf_dir, flat=False):
    directed = ranked(spark, sf_dir).withColumn("direction", F.when(F.col("candidate") == "move", -1.0).otherwise(1.0))
    return m.portfolio_returns(directed, BY, least=2, flat_cost=flat)


def curve(spark, sf_dir):
    return m.sleeve_curve(portfolio(spark, sf_dir), ["candidate"])


def small_curve(spark, sf_dir):
    """The curve at a hundredth of its returns, so that it can be compounded."""
    return curve(spark, sf_dir).withColumns({c: F.col(c) * 0.01 for c in ("net_return", "raw_return")})


def register(catalog: Catalog) -> None:
    start = f"with {MINUTE}, {LONG}, {RANKED}"

    @catalog.query(
        "rank_ic_minute",
        f"{start}, {ICS} select candidate, horizon, shard_index, round(avg(ic), 6) as ic_mean, round(avg(abs(ic)), 6) as ic_abs_mean, count(ic) as ic_count, round(avg(case when ic > 1e-12 then 1.0 else 0.0 end), 6) as ic_hit_rate from ics where n >= 2 and ic is not null group by all".replace("shard_index, trade_time", "trade_time").replace("candidate, horizon, shard_index, ", "candidate, horizon, ").replace("candidate, horizon, shard_index", "candidate, horizon"),
    )
    def rank_ic_minute(spark, sf_dir):
        by = ["candidate", "horizon"]
        rows = ranked(spark, sf_dir, (*by, "trade_time"))
        return _rounded(m.ic_summary(m.section_ics(rows, by, "trade_time", least=2), by), by)

    whole = start.replace("candidate, horizon, shard_index, trade_time", "candidate, horizon, trade_time")

    @catalog.query(
        "spread_minute",
        f"""{whole}, sp as (select candidate, horizon, trade_time, avg(case when sr >= 0.8 then label end) - avg(case when sr <= 0.2 then label end) as spread, count(*) as n from rk group by all)
        select candidate, horizon, round(avg(spread), 6) as spread_mean, round(avg(abs(spread)), 6) as spread_abs_mean, count(spread) as spread_count, round(avg(case when spread > 0 then 1.0 else 0.0 end), 6) as spread_hit_rate
        from sp where n >= 5 and spread is not null group by all""",
    )
    def spread_minute(spark, sf_dir):
        by = ["candidate", "horizon"]
        return _rounded(m.spread_summary(m.section_spreads(ranked(spark, sf_dir, (*by, "trade_time")), by, "trade_time"), by), by)

    @catalog.query(
        "turnover_minute",
        f"""{whole}, v as (select distinct candidate, trade_time, code, sr from rk where horizon = 1 and sr is not null), s as (select candidate, trade_time, list(code) filter (sr >= 0.8) as tp, list(code) filter (sr <= 0.2) as bt from v group by all),
        p as (select *, lag(coalesce(tp, [])) over w as pt, lag(coalesce(bt, [])) over w as pb, row_number() over w as rn from s window w as (partition by candidate order by trade_time))
        select candidate, round(avg(((1 - len(list_intersect(tp, pt)) / len(tp)::double) + (1 - len(list_intersect(bt, pb)) / len(bt)::double)) / 2), 6) as mean_one_way_turnover, count(*) as turnover_count
        from p where rn > 1 and len(tp) > 0 and len(bt) > 0 group by 1""",
    )
    def turnover_minute(spark, sf_dir):
        rows = ranked(spark, sf_dir, ("candidate", "horizon", "trade_time")).where("horizon = 1")
        return _rounded(m.turnover_summary(m.rank_turnover(rows, ["candidate"], "trade_time"), ["candidate"]), ["candidate"])

    part = "candidate, horizon, trade_time"

    @catalog.query(
        "wrong_lag_ic",
        f"""with {MINUTE}, {LONG}, wl as (select *, lag(signal) over w as sp, lead(signal) over w as sf from lg window w as (partition by candidate, horizon, code order by trade_time)),
        rw as (select *, {rank_sql("sp", part)} as spr, {rank_sql("sf", part)} as sfr, {rank_sql("label", part)} as lr from wl),
        a as (select candidate, horizon, trade_time, {corr_sql("spr", "lr")} as p, {corr_sql("sfr", "lr")} as f from rw group by all having count(*) >= 5)
        select candidate, horizon, round(avg(p), 6) as wrong_lag_prev_ic_mean, round(avg(f), 6) as wrong_lag_future_ic_mean from a group by all""",
    )
    def wrong_lag_ic(spark, sf_dir):
        by = ["candidate", "horizon"]
        rows = m.wrong_lag_signals(long_signals(spark, sf_dir), by, "trade_time")
        out = None
        for which in ("prev", "future"):
            r = rows.withColumns({"signal_rank": m.section_rank(f"signal_{which}", [*by, "trade_time"]), "label_rank": m.section_rank("label", [*by, "trade_time"])})
            ic = m.section_ics(r, by, "trade_time").groupBy(*by).agg(F.avg("ic").alias(f"wrong_lag_{which}_ic_mean"))
            out = ic if out is None else out.join(ic, by, "full")
        return _rounded(out, by)

    @catalog.query(
        "loop_metrics",
        f"""{whole}, sec as (select {part}, {corr_sql("sr", "lr")} as ic, avg(case when sr >= 0.8 then label end) - avg(case when sr <= 0.2 then label end) as spread from rk group by all having count(*) >= 5),
        ms as (select candidate, horizon, avg(ic) as ic_mean, avg(abs(ic)) as ic_abs_mean, avg(case when ic > 1e-12 then 1.0 when ic is not null then 0.0 end) as ic_hit_rate, avg(spread) as spread_mean, avg(abs(spread)) as spread_abs_mean, avg(case when spread > 0 then 1.0 when spread is not null then 0.0 end) as spread_hit_rate from sec group by all),
        wl as (select *, lag(signal) over w as sp, lead(signal) over w as sf from lg window w as (partition by candidate, horizon, code order by trade_time)),
        rw as (select *, {rank_sql("sp", part)} as spr, {rank_sql("sf", part)} as sfr, {rank_sql("label", part)} as lr from wl),
        la as (select {part}, {corr_sql("spr", "lr")} as p, {corr_sql("sfr", "lr")} as f from rw group by all having count(*) >= 5),
        lm as (select candidate, horizon, avg(p) as wrong_lag_prev_ic_mean, avg(f) as wrong_lag_future_ic_mean from la group by all),
        v as (select distinct candidate, trade_time, code, sr from rk where horizon = 1 and sr is not null), s as (select candidate, trade_time, list(code) filter (sr >= 0.8) as tp, list(code) filter (sr <= 0.2) as bt from v group by all),
        p as (select *, lag(coalesce(tp, [])) over w as pt, lag(coalesce(bt, [])) over w as pb, row_number() over w as rn from s window w as (partition by candidate order by trade_time)),
        tn as (select candidate, avg(((1 - len(list_intersect(tp, pt)) / len(tp)::double) + (1 - len(list_intersect(bt, pb)) / len(bt)::double)) / 2) as mean_one_way_turnover from p where rn > 1 and len(tp) > 0 and len(bt) > 0 group by 1),
        al as (select * from ms left join lm using (candidate, horizon) left join tn using (candidate))
        select candidate, horizon, round(ic_mean, 6) as aligned_ic_mean, round(ic_abs_mean, 6) as ic_abs_mean, round(ic_hit_rate, 6) as ic_hit_rate, round(spread_mean, 6) as spread_mean, round(spread_abs_mean, 6) as spread_abs_mean, round(spread_hit_rate, 6) as spread_hit_rate,
        round(wrong_lag_prev_ic_mean, 6) as wrong_lag_prev_ic_mean, round(wrong_lag_future_ic_mean, 6) as wrong_lag_future_ic_mean, round(mean_one_way_turnover, 6) as mean_one_way_turnover,
        concat_ws('|', case when ic_mean is null or ic_mean <= 0 then 'primary_direction_not_reproduced' end, case when abs(wrong_lag_future_ic_mean) >= abs(ic_mean) * 0.9 then 'future_signal_wrong_lag_too_strong' end, case when mean_one_way_turnover > 0.95 then 'extreme_minute_turnover' end) as blocker_flags from al""",
    )
    def loop_metrics(spark, sf_dir):
        from spindrift.catalog.search import measure

        rows = [{"expression_hash": n, "expression": text} for n, text in FORMULAS.items()]
        found, _ = measure(minute_panel(spark, sf_dir), tuple(HORIZONS))(rows)
        means = ["aligned_ic_mean", "ic_abs_mean", "ic_hit_rate", "spread_mean", "spread_abs_mean", "spread_hit_rate", "wrong_lag_prev_ic_mean", "wrong_lag_future_ic_mean", "mean_one_way_turnover"]
        return found.select(F.col("expression_hash").alias("candidate"), "horizon", *[rnd(F.col(c)).alias(c) for c in means], "blocker_flags")

    shard = f"""{start}, sp as (select {SECTION}, avg(case when sr >= 0.8 then label end) - avg(case when sr <= 0.2 then label end) as spread from rk group by all),
    sm as (select {PORT_BY}, avg(spread) as spread_mean, avg(abs(spread)) as spread_abs_mean, avg(case when spread > 0 then 1.0 else 0.0 end) as spread_hit_rate from sp where spread is not null group by all),
    mt as (select r.candidate, r.horizon, r.shard_index, count(distinct signal) as signal_unique, count(signal) as signal_nonnull, count(*) as eval_rows from rk r group by all),
    ag as (select candidate, horizon, count(*) as shard_count, avg(spread_mean) as spread_mean, avg(spread_abs_mean) as spread_abs_mean, avg(spread_hit_rate) as spread_hit_rate, min(signal_unique) as signal_unique_min,
      sum(signal_nonnull) as signal_nonnull_sum, sum(eval_rows) as eval_rows_sum from mt left join sm using (candidate, horizon, shard_index) group by all)"""

    def _shard_metrics(spark, sf_dir):
        rows = ranked(spark, sf_dir)
        counts = rows.groupBy(*BY).agg(F.count_distinct("signal").alias("signal_unique"), F.count("signal").alias("signal_nonnull"), F.count("*").alias("eval_rows"))
        return counts.join(m.spread_summary(m.section_spreads(rows, BY, "trade_time", least=1), BY), BY, "left")

    @catalog.query(
        "shard_aggregate",
        f"{shard} select candidate, horizon, shard_count, round(spread_mean, 6) as spread_mean, round(spread_abs_mean, 6) as spread_abs_mean, round(spread_hit_rate, 6) as spread_hit_rate, signal_unique_min, cast(signal_nonnull_sum as bigint) as signal_nonnull_sum, cast(eval_rows_sum as bigint) as eval_rows_sum from ag",
    )
    def shard_aggregate(spark, sf_dir):
        return _rounded(m.shard_aggregate(_shard_metrics(spark, sf_dir), ["candidate", "horizon"]), ["candidate", "horizon"])

    agg = """a as (select c_custkey as candidate, case when c_custkey % 9 = 4 then null else round(c_acctbal / 50000, 6) end as ic_mean, round(c_acctbal / 90000, 6) as spread_mean,
      case when c_custkey % 6 = 1 then null else round((c_acctbal + c_custkey) / 60000, 6) end as wrong_lag_future_ic_mean, case when c_custkey % 8 = 3 then null else (c_custkey % 100) / 100.0::double end as mean_one_way_turnover, case when c_custkey % 2 = 0 then 1 else -1 end as expected_direction from customer)"""

    @catalog.query(
        "score_flags",
        f"""with {agg}, s as (select *, ic_mean * expected_direction as al from a) select candidate, round(al, 6) as aligned_ic_mean, concat_ws('|', case when al is null or al <= 0 then 'primary_direction_not_reproduced' end,
        case when abs(wrong_lag_future_ic_mean) >= abs(al) * 0.9 then 'future_signal_wrong_lag_too_strong' end, case when mean_one_way_turnover > 0.95 then 'extreme_minute_turnover' end) as blocker_flags,
        case when blocker_flags = '' then 'bl_signal_materialized_pass' else 'bl_signal_materialized_watch' end as decision from s""",
    )
    def score_flags(spark, sf_dir):
        from spindrift.sources.panels import table

        k, bal = F.col("c_custkey"), F.col("c_acctbal")
        a = table(spark, sf_dir, "customer").select(
            k.alias("candidate"),
            F.when(k % 9 != 4, rnd(bal / 50000)).alias("ic_mean"),
            rnd(bal / 90000).alias("spread_mean"),
            F.when(k % 6 != 1, rnd((bal + k) / 60000)).alias("wrong_lag_future_ic_mean"),
            F.when(k % 8 != 3, (k % 100) / 100.0).alias("mean_one_way_turnover"),
            F.when(k % 2 == 0, 1).otherwise(-1).alias("expected_direction"),
        )
        return m.score_flags(a).select("candidate", rnd(F.col("aligned_ic_mean")).alias("aligned_ic_mean"), "blocker_flags", "decision")

    names = list(FORMULAS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    per_pair = " union all ".join(f"select '{a}' as \"left\", '{b}' as \"right\", round({corr_sql(f'{a}_r', f'{b}_r')}, 6) as signal_rank_corr from w" for a, b in pairs)

    @catalog.query("pairwise_corr", f"with {MINUTE}, {LONG}, w as (select {', '.join(f'{rank_sql(n, 'trade_time')} as {n}_r' for n in names)} from sg) {per_pair}")
    def pairwise_corr(spark, sf_dir):
        wide = evaluate(minute_panel(spark, sf_dir), {n: f"CSRank({text})" for n, text in FORMULAS.items()})
        return _rounded(m.pairwise_correlation(wide, names), ["left", "right"])

    @catalog.query("daily_rank_ic", f"with {DAILY}, {WORK} select date, round(rank_ic, 6) as rank_ic from ({reranked_sql('wk')})")
    def daily_rank_ic(spark, sf_dir):
        return _rounded(m.reranked_ic(work(spark, sf_dir), ["date"]), ["date"])

    @catalog.query(
        "daily_ic_spread",
        f"""with {DAILY}, {WORK}, q as (select *, quantile_cont(signal, 0.2) over (partition by date) as lo, quantile_cont(signal, 0.8) over (partition by date) as hi from wk),
        s as (select date, avg(case when signal >= hi then forward_return end) - avg(case when signal <= lo then forward_return end) as sp from q group by 1 having count(*) >= 5 and count(distinct signal) >= 2)
        select date, year(date) || 'Q' || quarter(date) as "window", round(sp, 6) as long_short_return, round(rank_ic, 6) as rank_ic from s left join ({reranked_sql("wk")}) using (date)""",
    )
    def daily_ic_spread(spark, sf_dir):
        return _rounded(m.daily_ic_spread(work(spark, sf_dir)), ["date", "window"])

    pool = lambda blocked, side, order: f"select date, code, forward_return, '{side}' as side from (select *, row_number() over (partition by date order by signal {order}, code) as r, greatest(ceil(count(*) over (partition by date) * 0.2), 1) as k, count(*) over (partition by date) as n, max(signal) over (partition by date) > min(signal) over (partition by date) as varied from wk where not {blocked}) where r <= k and n >= 5 and varied"
    sides = f"sd as ({pool(m.LONG_BLOCKED, 'top', 'desc')} union all {pool(m.SHORT_BLOCKED, 'bottom', '')})"

    def turned(source: str) -> str:
        return f"""pl as (select side, date, row_number() over (partition by side order by date) as place from (select distinct side, date from {source})), ky as (select s.*, place, lag(place) over (partition by side, code order by place) = place - 1 as kept from {source} s join pl using (side, date)),
        tv as (select date, side, place, 1 - count(*) filter (kept) / count(*)::double as t, count(*) as size from ky group by all)"""

    @catalog.query(
        "tradable_daily",
        f"""with {DAILY}, {WORK}, ok as (select date from wk group by 1 having count(*) >= 5 and count(distinct signal) >= 2), {sides}, {turned("sd")},
        tt as (select date, case when min(place) > 1 then avg(t) end as t from tv group by 1 having count(*) = 2), sp as (select date, avg(case when side = 'top' then forward_return end) - avg(case when side = 'bottom' then forward_return end) as s from sd group by 1)
        select date, year(date) || 'Q' || quarter(date) as "window", round(rank_ic, 6) as rank_ic, round(s, 6) as long_short_return, round(t, 6) as average_one_way_turnover
        from ok left join ({reranked_sql("(select * from wk where not " + m.IC_BLOCKED + ")")}) using (date) left join sp using (date) left join tt using (date)""",
    )
    def tradable_daily(spark, sf_dir):
        return _rounded(m.tradable_daily(work(spark, sf_dir)), ["date", "window"])

    @catalog.query(
        "bucket_turnover",
        f"""with {DAILY}, {WORK}, sd as ({pool("false", "top", "desc")} union all {pool("false", "bottom", "")}), {turned("sd")}
        select date, max(size) as side_count, round(max(case when side = 'top' and place > 1 then t end), 6) as top_turnover, round(max(case when side = 'bottom' and place > 1 then t end), 6) as bottom_turnover,
        round((max(case when side = 'top' and place > 1 then t end) + max(case when side = 'bottom' and place > 1 then t end)) / 2, 6) as average_one_way_turnover from tv group by 1""",
    )
    def bucket_turnover(spark, sf_dir):
        return _rounded(m.bucket_turnover(work(spark, sf_dir)), ["date"])

    fitted = lambda blocked: f"(select * from wk where not {blocked} and date in (select date from fit))"
    pick = lambda blocked, side, order: f"select date, code, forward_return, volume, '{side}' as side from (select *, row_number() over (partition by date order by signal {order}, code) as r, greatest(ceil(count(*) over (partition by date) * 0.2), 1) as k from {fitted(blocked)} x where date in (select date from bo)) where r <= k"

    @catalog.query(
        "quarterly_validation",
        f"""with {DAILY}, {WORK}, fit as (select date from wk where not {m.IC_BLOCKED} group by 1 having count(*) >= 5 and count(distinct signal) >= 2),
        bo as (select date from {fitted(m.LONG_BLOCKED)} group by 1 having count(*) >= 5 intersect select date from {fitted(m.SHORT_BLOCKED)} group by 1 having count(*) >= 5),
        sd as ({pick(m.LONG_BLOCKED, "top", "desc")} union all {pick(m.SHORT_BLOCKED, "bottom", "")}),
        rt as (select date, avg(case when side = 'top' then forward_return end) as lo, avg(case when side = 'top' then forward_return end) - avg(case when side = 'bottom' then forward_return end) as sp, avg(case when side = 'top' then volume end) as vol from sd group by 1),
        ex as (select window_, date, count(*) filter {m.IC_BLOCKED} as a, count(*) filter {m.LONG_BLOCKED} as b, count(*) filter {m.SHORT_BLOCKED} as c from wk group by 1, 2),
        dd as (select ex.*, rank_ic, lo, sp, vol, ex.date in (select date from fit) as is_fit from ex left join ({reranked_sql("(select * from wk where not " + m.IC_BLOCKED + ")")}) using (date) left join rt using (date))
        select window_ as "window", count(rank_ic) as trading_day_count, round(avg(rank_ic), 6) as mean_rank_ic, round(avg(case when rank_ic is not null then case when rank_ic > 1e-12 then 1.0 else 0.0 end end), 6) as rank_ic_hit_rate,
        round(avg(lo), 6) as mean_long_return, round({SORTINO.format("lo")}, 6) as long_sortino, round(avg(sp), 6) as mean_long_short_return, round({SORTINO.format("sp")}, 6) as long_short_sortino,
        cast(sum(a) as bigint) as ic_excluded_rows, cast(sum(case when is_fit then b else 0 end) as bigint) as long_excluded_rows, cast(sum(case when is_fit then c else 0 end) as bigint) as short_excluded_rows, round(avg(vol), 6) as mean_volume from dd group by 1""",
    )
    def quarterly_validation(spark, sf_dir):
        return m.quarterly_validation(work(spark, sf_dir), diagnostics={"volume": "volume"})

    @catalog.query(
        "tradability_summary",
        f"with {DAILY}, {WORK} select {', '.join(f'count(*) filter ({w}_{c}) as {w}_{c}_rows' for w in ('entry', 'exit') for c in ('limit_up', 'limit_down', 'suspended'))} from wk",
    )
    def tradability_summary(spark, sf_dir):
        return m.tradability_summary(work(spark, sf_dir))

    @catalog.query(
        "capacity_diag",
        f"""with {DAILY}, {WORK}, p as (select *, row_number() over (partition by date order by signal desc, code) as r, greatest(ceil(count(*) over (partition by date) * 0.2), 1) as k from wk where not {m.LONG_BLOCKED})
        select date, round(avg(amount), 4) as mean_amount, round(avg(volume), 6) as mean_volume from p where r <= k group by 1""",
    )
    def capacity_diag(spark, sf_dir):
        return m.capacity_diagnostics(work(spark, sf_dir), ["amount", "volume"]).select("date", rnd(F.col("mean_amount"), 4).alias("mean_amount"), rnd(F.col("mean_volume")).alias("mean_volume"))

    @catalog.query("sortino_daily", f"with {DAILY}, {WORK} select code, round({SORTINO.format('forward_return')}, 6) as sortino from wk group by 1")
    def sortino_daily(spark, sf_dir):
        return work(spark, sf_dir).groupBy("code").agg(sortino_of_negatives(F.col("forward_return")).alias("sortino"))

    @catalog.query("sortino_portfolio", f"with {DAILY}, {WORK} select code, round({SHORTFALL.format('forward_return')}, 6) as sortino from wk group by 1")
    def sortino_portfolio(spark, sf_dir):
        return _rounded(work(spark, sf_dir).groupBy("code").agg(sortino_of_shortfall(F.col("forward_return")).alias("sortino")), ["code"])

    @catalog.query(
        "max_drawdown",
        f"""with {DAILY}, {WORK}, e as (select *, product(1 + forward_return) over w as eq from wk window w as (partition by code order by date rows unbounded preceding)),
        f as (select code, eq / greatest(max(eq) over (partition by code order by date rows unbounded preceding), 1.0) - 1 as fall from e) select code, round(least(min(fall), 0.0), 6) as max_drawdown from f group by 1""",
    )
    def max_drawdown(spark, sf_dir):
        return _rounded(m.max_drawdown(work(spark, sf_dir), ["code"], "date", "forward_return"), ["code"])

    @catalog.query("quantile_interp", f"with {DAILY} select code, round(quantile_cont(close, 0.05), 4) as p05, round(quantile_cont(close, 0.25), 4) as p25, round(quantile_cont(close, 0.95), 4) as p95 from daily group by 1")
    def quantile_interp(spark, sf_dir):
        return daily_panel(spark, sf_dir).groupBy("code").agg(*[rnd(F.percentile("close", F.lit(q)), 4).alias(n) for n, q in (("p05", 0.05), ("p25", 0.25), ("p95", 0.95))])

    @catalog.query(
        "portfolio_pnl",
        f"{start}, {PORT} select {PORT_BY}, trade_time, top_count, bottom_count, round(raw_return, 6) as raw_return, round(one_way_turnover, 6) as one_way_turnover, round(trading_cost, 8) as trading_cost, round(net_return, 6) as net_return from pn",
    )
    def portfolio_pnl(spark, sf_dir):
        p = portfolio(spark, sf_dir)
        return p.select(*BY, "trade_time", "top_count", "bottom_count", *[rnd(F.col(c)).alias(c) for c in ("raw_return", "one_way_turnover", "net_return")], rnd(F.col("trading_cost"), 8).alias("trading_cost"))

    @catalog.query(
        "fragment_replay",
        f"{start}, {PORT} select {PORT_BY}, trade_time, round(raw_return, 6) as raw_return, 0.001::double as trading_cost, round(raw_return - 0.001::double, 6) as net_return from pf",
    )
    def fragment_replay(spark, sf_dir):
        p = portfolio(spark, sf_dir, flat=True)
        return p.select(*BY, "trade_time", rnd(F.col("raw_return")).alias("raw_return"), rnd(F.col("trading_cost"), 8).alias("trading_cost"), rnd(F.col("net_return")).alias("net_return"))

    @catalog.query("sleeve_curve", f"{start}, {PORT} select candidate, trade_time, round(net_return, 6) as net_return, round(raw_return, 6) as raw_return, round(one_way_turnover, 6) as one_way_turnover, sleeve_count from cv")
    def sleeve_curve(spark, sf_dir):
        return _rounded(curve(spark, sf_dir), ["candidate", "trade_time"])

    @catalog.query("daily_pnl", f"{start}, {PORT} select candidate, cast(trade_time as date) as date, round(sum(net_return), 6) as day_return from cv group by 1, 2")
    def daily_pnl(spark, sf_dir):
        return _rounded(m.daily_returns(curve(spark, sf_dir), ["candidate"]), ["candidate", "date"])

    @catalog.query(
        "curve_summary",
        f"""{start}, {PORT}, cs as (select candidate, trade_time, net_return * 0.01::double as net_return, raw_return * 0.01::double as raw_return, one_way_turnover from cv),
        dy as (select candidate, cast(trade_time as date) as date, sum(net_return) as day_return from cs group by 1, 2), ds as (select candidate, count(*) as day_count, {SHORTFALL.format("day_return")} as day_sortino from dy group by 1),
        e as (select *, product(1 + net_return) over (partition by candidate order by trade_time rows unbounded preceding) as eq from cs), dr as (select candidate, least(min(fall), 0.0) as max_drawdown from (select candidate, eq / greatest(max(eq) over (partition by candidate order by trade_time rows unbounded preceding), 1.0) - 1 as fall from e) group by 1),
        ow as (select candidate, count(net_return) as curve_count, avg(net_return) as a, avg(raw_return) as b, avg(case when net_return > 0 then 1.0 else 0.0 end) as h, {SHORTFALL.format("net_return")} as ms, avg(one_way_turnover) as t from cs group by 1)
        select candidate, curve_count, round(a, 6) as net_mean_return, round(b, 6) as raw_mean_return, round(h, 6) as net_hit_rate, round(ms, 6) as minute_sortino, round(t, 6) as mean_one_way_turnover, day_count, round(day_sortino, 6) as day_sortino, round(max_drawdown, 6) as max_drawdown
        from ow join ds using (candidate) join dr using (candidate)""",
    )
    def curve_summary(spark, sf_dir):
        return _rounded(m.curve_summary(small_curve(spark, sf_dir), ["candidate"]), ["candidate"])

    @catalog.query("day_bootstrap")
    def day_bootstrap(spark, sf_dir):
        return m.day_bootstrap(m.daily_returns(curve(spark, sf_dir), ["candidate"]), ["candidate"])

    @catalog.query("block_bootstrap")
    def block_bootstrap(spark, sf_dir):
        pieces = curve(spark, sf_dir).select("candidate", F.to_date("trade_time").alias("day"), "trade_time", "net_return")
        return m.day_bootstrap(pieces, ["candidate"], iterations=1000, value="net_return", block="day")

    @catalog.query("fragment_bootstrap")
    def fragment_bootstrap(spark, sf_dir):
        pieces = curve(spark, sf_dir).select("candidate", "trade_time", "net_return")
        return m.day_bootstrap(pieces, ["candidate"], iterations=1000, value="net_return")

    @catalog.query("train_reward")
    def train_reward(spark, sf_dir):
        rows = portfolio(spark, sf_dir)
        split = m.chronological_split(rows, ["shard_index"], "trade_time")
        rows = rows.join(split, ["shard_index", "trade_time"])
        sleeves = m.sleeve_curve(rows.withColumn("horizon", F.lit(0)), ["candidate", "split", "horizon"]).unionByName(m.sleeve_curve(rows, ["candidate", "split", "horizon"]))
        summaries = m.curve_summary(sleeves, ["candidate", "split", "horizon"])
        train = sleeves.where("split = 'train' and horizon = 0")
        boots = m.day_bootstrap(m.daily_returns(train, ["candidate"]), ["candidate"])
        inherited = spark.createDataFrame([("flow", ""), ("move", "crowded"), ("errors", None)], "candidate string, inherited_blockers string")
        return m.train_reward(summaries, boots, inherited, list(HORIZONS))

    @catalog.query(
        "split_reward",
        f"""with {MINUTE}, t as (select distinct shard_index, trade_time from minute), p as (select *, row_number() over (partition by shard_index order by trade_time) - 1 as i, count(*) over (partition by shard_index) as n from t),
        e as (select *, greatest(1, least(n, round_even(n * 0.6, 0))) as te from p), f as (select *, greatest(te, least(n, te + round_even(n * 0.2, 0))) as ve from e)
        select shard_index, trade_time, case when i < te then 'train' when i < ve then 'validation' else 'holdout' end as split from f""",
    )
    def split_reward(spark, sf_dir):
        return m.chronological_split(minute_panel(spark, sf_dir), ["shard_index"], "trade_time")

    @catalog.query(
        "split_audit",
        f"""with {DAILY}, t as (select distinct date from daily), p as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from t)
        select date, case when i < floor(n * 0.6) then 'train' when i < floor(n * 0.8) then 'validation' else 'test' end as split from p""",
    )
    def split_audit(spark, sf_dir):
        return m.audit_split(daily_panel(spark, sf_dir))

    @catalog.query(
        "exposure_audit",
        f"""with {DAILY}, b as (select date, code, gappy / nullif(volume, 0) as signal, amount, volume, close from daily), l as (select date, code, signal, c.control, case c.control when 'amount' then amount when 'volume' then volume else close end as forward_return
          from b, (values ('amount'), ('volume'), ('close')) c(control) where signal is not null)
        select control, round(avg(rank_ic), 6) as mean_exposure, round(avg(abs(rank_ic)), 6) as mean_abs_exposure, count(*) as dates from ({reranked_sql("l", "date, control")}) where rank_ic is not null group by 1""",
    )
    def exposure_audit(spark, sf_dir):
        panel = evaluate(daily_panel(spark, sf_dir), {"signal": "Div($gappy,$volume)"})
        e = m.exposures(panel, "signal", ["amount", "volume", "close"]).where("exposure is not null")
        return _rounded(e.groupBy("control").agg(F.avg("exposure").alias("mean_exposure"), F.avg(F.abs("exposure")).alias("mean_abs_exposure"), F.count("*").alias("dates")), ["control"])

    res = lambda y, x: f"case when {y} is not null and {x} is not null and count(case when {x} is not null then {y} end) over d >= 5 then {y} - avg(case when {x} is not null then {y} end) over d - covar_pop({y}, case when {y} is not null then {x} end) over d / nullif(var_pop(case when {y} is not null then {x} end) over d, 0) * ({x} - avg(case when {y} is not null then {x} end) over d) end"

    @catalog.query(
        "exposure_residual",
        f"""with {DAILY}, b as (select *, gappy / nullif(volume, 0) as s0 from daily), r1 as (select *, {res("s0", "volume")} as s1 from b window d as (partition by date)), r2 as (select *, {res("s1", "close")} as s2 from r1 window d as (partition by date)),
        g as (select *, case when count(s2) over w >= 3 then s2 - avg(s2) over w end as s3 from (select *, code_no % 5 as grp from r2) window w as (partition by date, grp)) select code, date, round(s2, 3) as residual, round(s3, 3) as neutral from g""",
    )
    def exposure_residual(spark, sf_dir):
        panel = evaluate(daily_panel(spark, sf_dir), {"signal": "Div($gappy,$volume)"}).withColumn("grp", F.col("code_no") % 5)
        out = m.group_demean(m.residualize(panel, "signal", ["volume", "close"]), "signal_residual", "grp")
        return out.select("code", "date", rnd(F.col("signal_residual"), 3).alias("residual"), rnd(F.col("signal_residual_neutral"), 3).alias("neutral"))

    def audit_sql(h: int) -> str:
        source = f"(select * from wk{h} where not {m.IC_BLOCKED})"
        return f"select {h} as horizon, round(avg(rank_ic), 6) as mean_rank_ic from ({reranked_sql(source)})"

    audited = ", ".join(
        WORK.replace("wk0", f"wk0{h}").replace("wk1", f"wk1{h}").replace("wk as", f"wk{h} as").replace("lead(close, 2)", f"lead(close, {h + 1})").replace('(("entry", 1), ("exit", 2))', "") for h in (2, 5, 10)
    )

    @catalog.query("strict_audit", f"with {DAILY}, {audited} {' union all '.join(audit_sql(h) for h in (2, 5, 10))}")
    def strict_audit(spark, sf_dir):
        panel = evaluate(daily_panel(spark, sf_dir), {"signal": "Div($gappy,$volume)", "move": "Mom($close,1)"}).withColumns(
            {"limit_up": F.coalesce(F.col("move") > 1.5, F.lit(False)), "limit_down": F.coalesce(F.col("move") < -0.7, F.lit(False)), "suspended": (F.col("code_no") + F.month("date")) % 17 == 3}
        )
        out = None
        for h in (2, 5, 10):
            daily = m.tradable_daily(m.tradable_work(panel, h, 1)).withColumn("horizon", F.lit(h))
            out = daily if out is None else out.unionByName(daily)
        return m.net_spreads(out, ["horizon"]).select("horizon", "mean_rank_ic")

    @catalog.query(
        "watchlist",
        f"""with {DAILY}, {SIGNAL}, l as (select * from sig where date = (select max(date) from sig)), r as (select *, {rank_sql("signal", "date")} as rank_pct, row_number() over (order by signal desc, code) as hi, row_number() over (order by signal, code) as lo from l)
        select code, round(rank_pct, 6) as rank_pct, 'top' as side from r where hi <= 5 union all select code, round(rank_pct, 6), 'bottom' from r where lo <= 5""",
    )
    def watchlist(spark, sf_dir):
        return m.watchlist(signals(spark, sf_dir), 5).select("code", rnd(F.col("rank_pct")).alias("rank_pct"), "side")
