"""Point-in-time joins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from spindrift.catalog import Catalog
from spindrift.catalog.panels_sql import DAILY, MINUTE
from spindrift.functions.numeric import steady_round as rnd
from spindrift.operators import joins as j
from spindrift.sources.panels import daily_panel, minute_panel, table

#: Facts of a code now and then: purchases of a user group, by day.
FACTS = """facts as (select 'U' || (user_id % 10) as code, cast(ts as date) as source_date, sum(value) as spent, count(*) as n from events
  where event_type = 'purchase' and user_id % 3 = 0 and day(ts) % 4 = 1 group by 1, 2)"""
MARKET = """market as (select cast(ts as date) as source_date, avg(value) as mood from events where event_type = 'signup' and day(ts) % 5 != 0 group by 1)"""
ONCE = """cut as (select 'U' || (user_id % 10) as code, cast(ts as date) as source_date, cast(min(hour(ts) * 60 + minute(ts)) as integer) as cutoff_minute, arg_min(value, (ts, event_id)) as first_value from events
  where event_type = 'error' and user_id % 7 = 2 group by 1, 2)"""
#: The filters that thin these inputs; queries named ``..._whole`` go without them.
THIN = {"facts": "user_id % 3 = 0 and day(ts) % 4 = 1", "market": "day(ts) % 5 != 0", "once": "user_id % 7 = 2", "statements": "o_custkey % 50 < 40 and day(o_orderdate) < 4"}


def whole(sql: str) -> str:
    """The same over all rows of an event type, or of orders."""
    for thin in THIN.values():
        sql = sql.replace(f" and {thin}", "").replace(f" where {thin}", "")
    return sql


def _facts(spark, sf_dir, thin):
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").where(THIN["facts"] if thin else "true")
    return events.groupBy(F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("code"), F.to_date("ts").alias("source_date")).agg(F.sum("value").alias("spent"), F.count("*").alias("n"))


def _market(spark, sf_dir, thin):
    events = table(spark, sf_dir, "events").where("event_type = 'signup'").where(THIN["market"] if thin else "true")
    return events.groupBy(F.to_date("ts").alias("source_date")).agg(F.avg("value").alias("mood"))


def _once(spark, sf_dir, thin):
    events = table(spark, sf_dir, "events").where("event_type = 'error'").where(THIN["once"] if thin else "true")
    return events.groupBy(F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("code"), F.to_date("ts").alias("source_date")).agg(
        F.min(F.hour("ts") * 60 + F.minute("ts")).alias("cutoff_minute"), F.min_by("value", F.struct("ts", "event_id")).alias("first_value")
    )


def register(catalog: Catalog) -> None:
    def both(name, sql):
        """Registers a query over thinned inputs, and as ``name_whole`` the same over whole tables."""

        def add(query):
            catalog.add(name, partial(query, thin=True), sql)
            catalog.add(f"{name}_whole", partial(query, thin=False), whole(sql))
            return query

        return add

    @both(
        "asof_stock",
        f"""with {MINUTE}, {FACTS} select m.code, m.trade_time, round(f.spent, 6) as spent, f.n from minute m asof left join facts f on m.code = f.code and m.date > f.source_date""",
    )
    def asof_stock(spark, sf_dir, thin):
        out = j.asof(minute_panel(spark, sf_dir), _facts(spark, sf_dir, thin), ["code"], "date", "source_date", ["spent", "n"])
        return out.select("code", "trade_time", rnd(F.col("spent"), 6).alias("spent"), "n")

    @both("asof_market", f"with {MINUTE}, {MARKET} select m.code, m.trade_time, round(f.mood, 6) as mood from minute m asof left join market f on m.date > f.source_date")
    def asof_market(spark, sf_dir, thin):
        out = j.asof_market(minute_panel(spark, sf_dir), _market(spark, sf_dir, thin), "date", "source_date", ["mood"])
        return out.select("code", "trade_time", rnd(F.col("mood"), 6).alias("mood"))

    @both(
        "event_cutoff_join",
        f"""with {MINUTE}, {ONCE}, x as (select m.*, c.cutoff_minute, c.first_value, hour(trade_time) * 60 + minute(trade_time) as mi from minute m left join cut c on m.code = c.code and m.date = c.source_date)
        select code, trade_time, case when mi >= cutoff_minute then 1.0 else 0.0 end::double as event_active, case when mi >= cutoff_minute then (mi - cutoff_minute)::double end as event_age_min,
          case when mi >= cutoff_minute then round(first_value, 6) end as first_value from x""",
    )
    def event_cutoff_join(spark, sf_dir, thin):
        out = j.event_cutoff_join(minute_panel(spark, sf_dir), _once(spark, sf_dir, thin), ["first_value"])
        return out.select("code", "trade_time", "event_active", "event_age_min", rnd(F.col("first_value"), 6).alias("first_value"))

    @catalog.query(
        "hhmm_cutoff",
        f"""with {MINUTE} select code, trade_time, case when strftime(trade_time, '%H%M') >= '0930' then round(close, 6) end as seen_by_0930, case when strftime(trade_time, '%H%M') >= '1500' then volume end as seen_at_1500, round(open, 6) as plain from minute""",
    )
    def hhmm_cutoff(spark, sf_dir):
        m = minute_panel(spark, sf_dir).select("code", "trade_time", rnd(F.col("close"), 6).alias("seen_by_0930"), F.col("volume").alias("seen_at_1500"), rnd(F.col("open"), 6).alias("plain"))
        return j.hhmm_cutoff(m, m.columns)

    @both(
        "prev_calendar_join",
        f"""with {MINUTE}, {FACTS}, s as (select code, lead(source_date) over (partition by code order by source_date) as date, spent from facts), k as (select distinct code, date from minute)
        select k.code, k.date, round(s.spent, 6) as spent from k left join s on k.code = s.code and k.date = s.date""",
    )
    def prev_calendar_join(spark, sf_dir, thin):
        days = minute_panel(spark, sf_dir).select("code", "date").distinct()
        return j.previous_calendar_join(days, _facts(spark, sf_dir, thin), ["spent"]).select("code", "date", rnd(F.col("spent"), 6).alias("spent"))

    statements = """st as (select 'S' || lpad(cast(o_custkey % 50 as varchar), 5, '0') as code, case when o_orderstatus = 'P' then null else cast(o_orderdate + interval 20 day as date) end as notice_date,
      cast(o_orderdate as date) as report_date, o_totalprice as profit, o_orderkey from orders where o_custkey % 50 < 40 and day(o_orderdate) < 4)"""

    @both(
        "asof_fundamental",
        f"""with {DAILY}, {statements}, u as (select code, notice_date, arg_max(profit, (profit, o_orderkey)) as profit, max(o_orderkey) filter (true) as k from st where notice_date is not null group by 1, 2)
        select d.code, d.date, u.profit from daily d asof left join u on d.code = u.code and d.date > u.notice_date""",
    )
    def asof_fundamental(spark, sf_dir, thin):
        o = table(spark, sf_dir, "orders").where(THIN["statements"] if thin else "true")
        st = o.select(
            F.concat(F.lit("S"), F.lpad((F.col("o_custkey") % 50).cast("string"), 5, "0")).alias("code"),
            F.when(F.col("o_orderstatus") != "P", F.to_date(F.col("o_orderdate") + F.expr("interval 20 days"))).alias("notice_date"),
            F.lit(None).cast("date").alias("update_date"),
            F.to_date("o_orderdate").alias("report_date"),
            F.col("o_totalprice").alias("profit"),
        )
        return j.asof_statements(daily_panel(spark, sf_dir), st, ["profit"]).select("code", "date", "profit")

    context = """ctx as (select 'S' || lpad(cast(o_custkey % 50 as varchar), 5, '0') as code, cast(date_trunc('month', o_orderdate) as date) as date, o_orderkey as k, o_totalprice as ctx_value from orders)"""

    def _context(spark, sf_dir):
        return table(spark, sf_dir, "orders").select(
            F.concat(F.lit("S"), F.lpad((F.col("o_custkey") % 50).cast("string"), 5, "0")).alias("code"), F.trunc("o_orderdate", "MM").alias("date"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("ctx_value")
        )

    joined = f"with {DAILY}, {context}, c as (select code, date, arg_max(ctx_value, k) as ctx_value, max(k) as k from ctx group by 1, 2) select d.code, d.date, c.ctx_value, c.k from daily d left join c on d.code = c.code and d.date = c.date"

    @catalog.query("ctx_exact_join", joined)
    def ctx_exact_join(spark, sf_dir):
        return j.exact_join(daily_panel(spark, sf_dir).select("code", "date"), _context(spark, sf_dir), ["code", "date"], ["k"]).select("code", "date", "ctx_value", "k")

    @catalog.query("join_preserves_rows", joined)
    def join_preserves_rows(spark, sf_dir):
        return j.join_keeping_rows(daily_panel(spark, sf_dir).select("code", "date"), _context(spark, sf_dir), ["code", "date"], ["k"]).select("code", "date", "ctx_value", "k")

    @both(
        "outer_context_merge",
        f"""with {FACTS}, {ONCE} select coalesce(f.code, c.code) as code, coalesce(f.source_date, c.source_date) as source_date, round(f.spent, 6) as spent, f.n, c.cutoff_minute, round(c.first_value, 6) as first_value
        from facts f full join cut c on f.code = c.code and f.source_date = c.source_date""",
    )
    def outer_context_merge(spark, sf_dir, thin):
        out = j.outer_merge([_facts(spark, sf_dir, thin), _once(spark, sf_dir, thin)], ["code", "source_date"])
        return out.withColumns({"spent": rnd(F.col("spent"), 6), "first_value": rnd(F.col("first_value"), 6)})

    @both(
        "sidecar_fold",
        f"""with {MINUTE}, {FACTS}, {ONCE} select m.code, m.trade_time, round(f.spent, 6) as spent, f.n, c.cutoff_minute, round(c.first_value, 6) as first_value from minute m
        left join facts f on m.code = f.code and m.date = f.source_date left join cut c on m.code = c.code and m.date = c.source_date""",
    )
    def sidecar_fold(spark, sf_dir, thin):
        sides = [s.withColumnRenamed("source_date", "date") for s in (_facts(spark, sf_dir, thin), _once(spark, sf_dir, thin))]
        out = j.fold_sidecars(minute_panel(spark, sf_dir).select("code", "trade_time", "date"), sides, lambda s: ["code", "date"])
        return out.select("code", "trade_time", rnd(F.col("spent"), 6).alias("spent"), "n", "cutoff_minute", rnd(F.col("first_value"), 6).alias("first_value"))

    hashes = "c as (select c_custkey as candidate_id, substr(sha256('expr' || (c_custkey % 300)), 1, 24) as expression_hash from customer), m as (select distinct substr(sha256('expr' || s_suppkey), 1, 24) as expression_hash from supplier where s_suppkey % 3 = 0)"

    @catalog.query("anti_memory", f"with {hashes} select candidate_id, expression_hash from c where expression_hash not in (select expression_hash from m)")
    def anti_memory(spark, sf_dir):
        hash_of = lambda key: F.substring(F.sha2(F.concat(F.lit("expr"), key.cast("string")), 256), 1, 24)
        candidates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), hash_of(F.col("c_custkey") % 300).alias("expression_hash"))
        memory = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(hash_of(F.col("s_suppkey")).alias("expression_hash"))
        return j.unseen(candidates, memory)

    @catalog.query(
        "lineage_check",
        """with i as (select c_custkey as candidate_id, 'h' || c_custkey as expression_hash, 'arm' || (c_custkey % 3) as generator_arm from customer where c_custkey % 4 != 0),
        r as (select case when c_custkey % 5 = 1 then c_custkey + 1 else c_custkey end as candidate_id, 'h' || c_custkey as expression_hash, 'arm' || (c_custkey % 3 + case when c_custkey % 7 = 2 then 1 else 0 end) as generator_arm from customer)
        select r.expression_hash, r.candidate_id, r.generator_arm, case when i.expression_hash is null then 'missing_input' when r.generator_arm is distinct from i.generator_arm then 'arm_mismatch'
          when r.candidate_id is distinct from i.candidate_id then 'id_mismatch' else 'consistent' end as lineage_status from r left join i using (expression_hash)""",
    )
    def lineage_check(spark, sf_dir):
        c = table(spark, sf_dir, "customer")
        key = F.col("c_custkey")
        arm = lambda n: F.concat(F.lit("arm"), n.cast("string")).alias("generator_arm")
        hashed = F.concat(F.lit("h"), key.cast("string")).alias("expression_hash")
        inputs = c.where("c_custkey % 4 != 0").select(key.alias("candidate_id"), hashed, arm(key % 3))
        results = c.select(F.when(key % 5 == 1, key + 1).otherwise(key).alias("candidate_id"), hashed, arm(key % 3 + F.when(key % 7 == 2, 1).otherwise(0)))
        return j.lineage_check(results, inputs)
