"""Panel readers and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.catalog import Catalog
from spindrift.catalog.panels_sql import DAILY, MINUTE
from spindrift.functions.numeric import steady_round as rnd
from spindrift.operators.selection import event_days, panel_filter
from spindrift.sources import panels


def _rounded(df, *columns):
    return df.withColumns({c: rnd(F.col(c), 6) for c in columns})


def register(catalog: Catalog) -> None:
    @catalog.query("scan_panel", f"with {DAILY} select code, date, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume, round(amount, 4) as amount from daily")
    def scan_panel(spark, sf_dir):
        panel = panels.daily_panel(spark, sf_dir).select(*panels.REQUIRED_DAILY)
        return _rounded(panel, "open", "high", "low", "close").withColumn("amount", rnd(F.col("amount"), 4))

    @catalog.query("scan_latest_date", f"with {DAILY} select max(date) as latest_date from daily")
    def scan_latest_date(spark, sf_dir):
        return panels.latest_date(panels.daily_panel(spark, sf_dir))

    @catalog.query(
        "scan_recent_window",
        f"with {DAILY}, m as (select max(date) as d from daily) select code, date, round(close, 6) as close, cast(d - 92 as date) as evaluation_start from daily, m where date >= d - 182",
    )
    def scan_recent_window(spark, sf_dir):
        out = panels.recent_rows(panels.daily_panel(spark, sf_dir))
        return _rounded(out, "close").select("code", "date", "close", "evaluation_start")

    @catalog.query(
        "scan_recent_quarters",
        f"""with {DAILY}, m as (select cast(date_trunc('quarter', max(date)) - interval 9 month as date) as s from daily)
        select code, date, round(close, 6) as close, s as evaluation_start from daily, m where date >= s - 90""",
    )
    def scan_recent_quarters(spark, sf_dir):
        out = panels.recent_quarters(panels.daily_panel(spark, sf_dir), 4)
        return _rounded(out, "close").select("code", "date", "close", "evaluation_start")

    @catalog.query(
        "panel_profile",
        f"""with {DAILY} select count(*) as row_count, count(distinct code) as code_count, min(date) as min_date, max(date) as max_date,
        count(*) filter (close is null) as missing_close, count(*) filter (gappy is null) as missing_gappy from daily""",
    )
    def panel_profile(spark, sf_dir):
        return panels.panel_profile(panels.daily_panel(spark, sf_dir), ["close", "gappy"])

    @catalog.query("distinct_times", f"with {MINUTE} select distinct trade_time from minute")
    def distinct_times(spark, sf_dir):
        return panels.distinct_times(panels.minute_panel(spark, sf_dir))

    sampled = """p as (select trade_time, row_number() over (order by trade_time) - 1 as place from (select distinct trade_time from minute)),
    n as (select count(*) as n from p), s as (select distinct cast(round_even(i * ((select n from n) - 1) / 16.0, 0) as integer) as place from range(17) t(i))"""

    @catalog.query("sample_times", f"with {MINUTE}, {sampled} select trade_time, cast(place as integer) as place from p where place in (select place from s)")
    def sample_times(spark, sf_dir):
        return panels.sampled_times(panels.minute_panel(spark, sf_dir), 17)

    @catalog.query(
        "windowed_read",
        f"""with {MINUTE}, {sampled}, t as (select distinct trade_time from p join s on p.place between s.place - 5 and s.place + 2)
        select code, trade_time, round(close, 6) as close from minute where trade_time in (select trade_time from t)""",
    )
    def windowed_read(spark, sf_dir):
        minutes = panels.minute_panel(spark, sf_dir)
        out = panels.time_windows(minutes, panels.sampled_times(minutes, 17), lookback=5, horizon=2)
        return _rounded(out, "close").select("code", "trade_time", "close")

    @catalog.query("semi_times", f"with {MINUTE}, {sampled} select code, trade_time, volume from minute where trade_time in (select trade_time from p where place in (select place from s))")
    def semi_times(spark, sf_dir):
        minutes = panels.minute_panel(spark, sf_dir)
        return minutes.join(panels.sampled_times(minutes, 17), "trade_time", "left_semi").select("code", "trade_time", "volume")

    @catalog.query(
        "status_dedupe",
        """with s as (select 'S' || l_suppkey as symbol, cast(date_trunc('month', l_shipdate) as date) as date, l_linenumber % 5 - 2 as status, case when l_linenumber <= 6 then 15 else 3 end as type from lineitem)
        select symbol, date, arg_max(status, (abs(status), status)) as status from s where type = 15 group by 1, 2""",
    )
    def status_dedupe(spark, sf_dir):
        lines = panels.table(spark, sf_dir, "lineitem")
        events = lines.select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
            F.trunc("l_shipdate", "MM").alias("date"),
            (F.col("l_linenumber") % 5 - 2).alias("status"),
            F.when(F.col("l_linenumber") <= 6, 15).otherwise(3).alias("type"),
        )
        return panels.best_status(events)

    @catalog.query(
        "panel_filter",
        f"""with {DAILY}, p as (select case when code_no % 9 = 4 then '880' || code when code_no % 9 = 5 then 'SH000' || code else code end as code, date,
          case when code_no % 11 = 3 then null else close end as close, case when code_no % 13 = 6 then 'index' else 'stock' end as instrument_type from daily)
        select code, date, round(close, 6) as close from p where close is not null and instrument_type = 'stock' and not regexp_matches(lower(code), '^(880|sh000|sz399|bj899)')""",
    )
    def panel_filter_query(spark, sf_dir):
        p = panels.daily_panel(spark, sf_dir)
        no = F.col("code_no")
        p = p.select(
            F.when(no % 9 == 4, F.concat(F.lit("880"), "code")).when(no % 9 == 5, F.concat(F.lit("SH000"), "code")).otherwise(F.col("code")).alias("code"),
            "date",
            F.when(no % 11 != 3, F.col("close")).alias("close"),
            F.when(no % 13 == 6, "index").otherwise("stock").alias("instrument_type"),
        )
        return _rounded(panel_filter(p), "close").select("code", "date", "close")

    @catalog.query(
        "event_day_panel",
        f"""with {DAILY}, e as (select date, sum(case when close > open then 1.0 else 0.0 end) as a, sum(case when high > close then 1.0 else 0.0 end) as b from daily group by 1),
        top as (select date from (select date, row_number() over (order by a * 25 + b * 5 desc, date) as r from e) where r <= 6),
        c as (select date, lag(date) over (order by date) as before from (select distinct date from daily)),
        pick as (select date from top union select before from c where date in (select date from top) and before is not null)
        select code, date, round(close, 6) as close from daily where date in (select date from pick)""",
    )
    def event_day_panel(spark, sf_dir):
        p = panels.daily_panel(spark, sf_dir)
        marked = p.withColumns({"a": (F.col("close") > F.col("open")).cast("double"), "b": (F.col("high") > F.col("close")).cast("double")})
        days = event_days(marked, {"a": 25.0, "b": 5.0}, count=6)
        return _rounded(p.join(days, "date", "left_semi"), "close").select("code", "date", "close")

    @catalog.query("data_contract")
    def data_contract(spark, sf_dir):
        found = [(n, panels.data_contract(spark, f"{sf_dir}/{n}.parquet", r)) for n, r in (("orders", ("o_orderkey",)), ("lineitem", panels.REQUIRED_DAILY), ("nowhere", ("x",)))]
        rows = [(n, c["exists"], "|".join(c["missing"]), c["can_start"], c["role"]) for n, c in found]
        return spark.createDataFrame(rows, "name string, exists boolean, missing string, can_start boolean, role string")
