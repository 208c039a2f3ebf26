"""Filters, picks and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.catalog import Catalog
from spindrift.catalog.panels_sql import DAILY
from spindrift.functions.numeric import steady_round as rnd
from spindrift.operators import selection as s
from spindrift.plans.compiler import evaluate
from spindrift.sources.panels import daily_panel, table

SIGNAL = "sig as (select code, date, code_no, round(gappy / nullif(volume, 0), 4) as signal, close from daily where gappy is not null)"


def signals(spark, sf_dir):
    panel = daily_panel(spark, sf_dir)
    out = evaluate(panel, {"signal": "Div($gappy,$volume)"}).where("signal is not null")
    return out.select("code", "date", "code_no", rnd(F.col("signal"), 4).alias("signal"), "close")


CANDIDATES = """cand as (select c_custkey as position, 'h' || c_custkey % 400 as expression_hash, 'arm' || (c_custkey % 4) as generator_arm, 'f' || (c_custkey % 37) as fields, 'lane' || (c_custkey % 5) as lane, round(c_acctbal, 2) as score from customer)"""


def candidates(spark, sf_dir):
    key = F.col("c_custkey")
    text = lambda start, n: F.concat(F.lit(start), n.cast("string"))
    return table(spark, sf_dir, "customer").select(
        key.alias("position"),
        text("h", key % 400).alias("expression_hash"),
        text("arm", key % 4).alias("generator_arm"),
        text("f", key % 37).alias("fields"),
        text("lane", key % 5).alias("lane"),
        rnd(F.col("c_acctbal"), 2).alias("score"),
    )


def register(catalog: Catalog) -> None:
    @catalog.query(
        "eval_range",
        f"""with {DAILY}, v as (select code, date, avg(close) over w as m, count(close) over w as n from daily window w as (partition by code order by date rows between 3 preceding and current row))
        select code, date, round(case when n >= 4 then m end, 6) as signal from v where date between date '1996-03-01' and date '1996-09-01'""",
    )
    def eval_range(spark, sf_dir):
        out = evaluate(daily_panel(spark, sf_dir), {"signal": "Mean($close,4)"})
        return s.evaluation_range(out, "1996-03-01", "1996-09-01").select("code", "date", rnd(F.col("signal"), 6).alias("signal"))

    @catalog.query(
        "topk_daily",
        f"""with {DAILY}, {SIGNAL}, r as (select *, greatest(ceil(count(*) over (partition by date) * 0.2), 1) as k, row_number() over (partition by date order by signal desc, code) as hi, row_number() over (partition by date order by signal, code) as lo from sig)
        select code, date, signal, 'top' as side from r where hi <= k union all select code, date, signal, 'bottom' from r where lo <= k""",
    )
    def topk_daily(spark, sf_dir):
        return s.pick_ends(signals(spark, sf_dir), 0.2).select("code", "date", "signal", "side")

    @catalog.query(
        "quantile_cut",
        f"""with {DAILY}, {SIGNAL}, r as (select *, quantile_cont(signal, 0.2) over (partition by date) as lo, quantile_cont(signal, 0.8) over (partition by date) as hi from sig)
        select code, date, signal, 'top' as side from r where signal >= hi union all select code, date, signal, 'bottom' from r where signal <= lo""",
    )
    def quantile_cut(spark, sf_dir):
        return s.pick_quantiles(signals(spark, sf_dir), 0.2).select("code", "date", "signal", "side")

    @catalog.query("dedupe_first", f"with {CANDIDATES} select expression_hash, position, score from (select *, row_number() over (partition by expression_hash order by score desc nulls last, position) as r from cand) where r = 1")
    def dedupe_first(spark, sf_dir):
        return s.first_of(candidates(spark, sf_dir), ["expression_hash"], [F.desc_nulls_last("score"), F.col("position")]).select("expression_hash", "position", "score")

    @catalog.query("topn_report", f"with {CANDIDATES} select position, score from cand order by coalesce(score, -999) desc, position limit 40")
    def topn_report(spark, sf_dir):
        return s.top_rows(candidates(spark, sf_dir), ["score"], 40, "position").select("position", "score")

    @catalog.query("capped_select")
    def capped_select(spark, sf_dir):
        # All proposals in order, partition by partition, until enough are picked.
        ordered = candidates(spark, sf_dir).orderBy(F.desc(F.coalesce("score", F.lit(-999.0))), "position")
        picked = s.pick_capped((r.asDict() for r in ordered.toLocalIterator()), 60, {"lane": 15, "fields": 4})
        return spark.createDataFrame([(r["position"], r["lane"], r["fields"]) for r in picked], "position long, lane string, fields string")

    @catalog.query(
        "arm_balanced",
        f"""with {CANDIDATES}, t as (select *, row_number() over (partition by generator_arm order by score desc, position) as turn, list_position(['arm2', 'arm0', 'arm3', 'arm1'], generator_arm) as a from cand)
        select position, generator_arm, turn from t order by turn, a limit 50""",
    )
    def arm_balanced(spark, sf_dir):
        out = s.balanced_pick(candidates(spark, sf_dir), ["arm2", "arm0", "arm3", "arm1"], 50, [F.desc("score"), F.col("position")])
        return out.select("position", "generator_arm", F.col("turn").cast("long").alias("turn"))

    @catalog.query("field_breadth", f"with {CANDIDATES}, t as (select *, row_number() over (partition by fields order by position) > 1 as later from cand) select position, fields from t order by later, position limit 60")
    def field_breadth(spark, sf_dir):
        return s.breadth_first(candidates(spark, sf_dir), 60).select("position", "fields")

    @catalog.query(
        "union_parts",
        "select s_suppkey as k, s_acctbal as a, cast(null as varchar) as b from supplier union all select c_custkey, null, c_mktsegment from customer",
    )
    def union_parts(spark, sf_dir):
        a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("a"))
        b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("b"))
        return s.union_parts([a, b])

    @catalog.query(
        "mix_unique",
        f"""with {CANDIDATES}, b as (select *, 0 as source_rank from cand where position % 2 = 0 union all select *, 1 from cand where position % 3 = 0),
        u as (select *, row_number() over (partition by expression_hash order by source_rank, position) as r from b) select expression_hash, position, source_rank from u where r = 1 order by source_rank, position limit 120""",
    )
    def mix_unique(spark, sf_dir):
        c = candidates(spark, sf_dir)
        return s.mix_unique(c.where("position % 2 = 0"), c.where("position % 3 = 0"), 120).select("expression_hash", "position", "source_rank")

    @catalog.query(
        "jaccard_overlap",
        """with i as (select distinct 'n' || c_nationkey as label, c_mktsegment || (c_custkey % 17) as item from customer), n as (select label, count(*) as n from i group by 1),
        p as (select a.label as left_label, b.label as right_label, count(*) as shared from i a join i b on a.item = b.item and a.label < b.label group by 1, 2)
        select left_label, right_label, shared, x.n + y.n - shared as united, round(shared / (x.n + y.n - shared)::double, 6) as jaccard, round(shared / x.n::double, 6) as left_covered
        from p join n x on x.label = left_label join n y on y.label = right_label""",
    )
    def jaccard_overlap(spark, sf_dir):
        c = table(spark, sf_dir, "customer")
        labels = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("label"), F.concat("c_mktsegment", (F.col("c_custkey") % 17).cast("string")).alias("item"))
        return s.label_overlaps(labels)
