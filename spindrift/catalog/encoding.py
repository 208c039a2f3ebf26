"""Fields, events, operators and formulas as profiles, and the conditions that stop a canary."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.catalog import Catalog
from spindrift.operators import encoder as e
from spindrift.operators import ledgers as led
from spindrift.operators.gates import STOP_CONDITIONS
from spindrift.sources.panels import table

#: Names and what they are encoded as, worked out by hand: field_name, kind, canonical name, eight numbers.
ENCODED = [
    ("$Close", "close", "price_ts", "close", (0.7, 0.1, 0.2, 0.25, 0.05, 1, 0, 0)),
    ("vrat", "turnover_rate", "crosssec", "turnover_rate", (0.15, 0.65, 0.1, 0.4, 0.95, 0, 0, 1)),
    ("amount", "amount", "volume_ts", "amount", (0.25, 0.85, 0.15, 0.3, 0.7, 0, 1, 0)),
    ("mom_5", "close_mom_5", "derived_price_ts", "close_mom_5", (1, 0.1, 0.15, 0.3, 0.1, 1, 0, 0)),
    ("vol20", "ret_std_20", "derived_price_ts", "ret_std_20", (0.6, 0.05, 0.1, 1, 0.15, 1, 0, 0)),
    ("volume_ma_126", "volume_mean_126", "derived_volume_ts", "volume_mean_126", (0.2, 0.75, 0.15, 0.25, 0.375, 0, 1, 0)),
    ("volume_mean999", "volume_mean_252", "derived_volume_ts", "volume_mean_252", (0.2, 0.75, 0.15, 0.25, 0.25, 0, 1, 0)),
    ("crowding_lag_0", "crowding_delay_1", "derived_crosssec", "crowding_delay_1", (0.3, 0.25, 0.15, 0.4, 0.65, 0, 0, 1)),
    ("foo_mom_5", "foo_mom_5", "derived_price_ts", None, (1, 0.1, 0.15, 0.3, 0.1, 1, 0, 0)),
    ("foo", "close", "price_ts", None, (0.7, 0.1, 0.2, 0.25, 0.05, 1, 0, 0)),
    ("fund_ocf_ratio", "fund_ocf_ratio", "fundamental_crosssec", "fund_ocf_ratio", (0.2, 0.25, 0.75, 0.2, 0.04, 0, 0, 1)),
    ("fund_cash_to_debt", "fund_cash_to_debt", "fundamental_crosssec", "fund_cash_to_debt", (0.05, 0.15, 0.7, 0.45, 0.05, 0, 0, 1)),
    ("market_cap", "market_cap", "capacity_crosssec", "market_cap", (0.1, 0.98, 0.35, 0.08, 0.28, 0, 0, 0)),
    ("is_market_high_board", "is_market_high_board", "event_crosssec", "is_market_high_board", (0.88, 0.08, 0.02, 0.86, 0.34, 0, 0, 1)),
    ("limit_up_streak", "limit_up_streak", "event_ts", "limit_up_streak", (0.86, 0.05, 0.04, 0.82, 0.3, 0, 0, 0)),
]
#: Event names and families, by hand; None where the name is no event's.
FAMILIES = {
    "limit_up_close_event": "limit_close", "limit_up_event": "limit_close", "limit_flip_up_to_down": "limit_close", "limit_down_open_event": "limit_open", "limit_up_touch_event": "limit_touch",
    "limit_up_break": "limit_break", "limit_down_touch_not_close": "limit_break", "limit_up_open_not_close": "limit_open_break", "limit_up_close_not_open": "limit_close_without_open",
    "limit_down_streak_touch": "limit_streak", "limit_up_touch_streak_ge_4": "limit_streak", "break_board_after_streak_ge_10": "limit_streak", "limit_down_rebound_after_streak_ge_2": "limit_down_repair",
    "limit_down_repair": "limit_down_repair", "limit_up_close_not_open_count_t5": "limit_event_count", "limit_up_any_open_not_close_in_t2": "limit_event_count", "post_market_high_board_tplus_3": "high_board",
    "break_after_high_board_tplus_1": "high_board", "seal_rate": "limit_seal_flow", "turnover_ratio_real": "event_liquidity", "actual_circulation_value": "event_capacity", "plate_score": "theme_plate",
    "close_limit_without_reason_record": "limit_data_quality", "reason_record_exists": "limit_reason_record", "open_board_record": "open_board_record", "limit_up_keep_times_vendor": "limit_streak_vendor",
    "limit_up_streak_ge_11": None, "limit_up_close_count_t1": None, "post_market_high_board_tplus_4": None, "close": None,
}
FLAGS = ("is_price", "is_volume", "is_across")
NAMES = [*e.FIRST_BATCH, "market_vol_state", "nothing_known"]


def _sql(value) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{float(value)}::double"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in rows)


def register(catalog: Catalog) -> None:
    traits = ", ".join(e.TRAITS)

    @catalog.query("field_encoding", f'select * from (values {_values([(*row[:4], *row[4]) for row in ENCODED])}) v(field, field_name, field_type, canonical_name, {traits}, {", ".join(FLAGS)})')
    def field_encoding(spark, sf_dir):
        x = e.encode_fields(spark.createDataFrame([(row[0],) for row in ENCODED], "field string"))
        return x.select("field", "field_name", "field_type", "canonical_name", *[F.get("vector", F.lit(k)).alias(n) for k, n in enumerate((*e.TRAITS, *FLAGS))])

    by_family = [(family, *v) for names, v in e.EVENT_TRAITS for family in (names.split() or ["limit_event_count"])]

    @catalog.query("event_profile", f"with v(field, family) as (values {_values(FAMILIES.items())}), p(family, {traits}) as (values {_values(by_family)}) select field, v.family, {traits} from v left join p on v.family = p.family")
    def event_profile(spark, sf_dir):
        x = spark.createDataFrame([(name,) for name in FAMILIES], "field string").withColumn("family", e.event_family(F.col("field")))
        x = x.withColumn("traits", e.event_traits(F.col("family")))
        return x.select("field", "family", *[F.get("traits", F.lit(k)).alias(t) for k, t in enumerate(e.TRAITS)])

    operators = ["Mean", "ma", "Mom", "Std", "Delay", "Delta", "CSRank"]
    added = (*e.TRAITS, "decay")
    plain = [(op.lower(), *base) for names, base, more in e.OPERATORS if more is None for op in names.split()]

    @catalog.query(
        "operator_profile",
        f"""with x as (select p_partkey, list_extract({operators}, (p_partkey % 7 + 1)::int) as op, least(greatest(p_size * 7 - 20, 1), 252) / 252.0::double as w from part),
        p(name, {", ".join(added)}) as (values {_values(plain)}), m as (select p_partkey, 0.1::double as momentum, 0::double as size, 0.05::double as value, -0.1::double as volatility, -0.35::double - 0.25::double * w as turnover, 0.35::double + 0.45::double * w as decay from x where op in ('Mean', 'ma'))
        select x.p_partkey, op as operator, {", ".join(f"round(coalesce(m.{c}, p.{c}, 0), 6) as {c}" for c in added)} from x left join m using (p_partkey) left join p on lower(op) = p.name""",
    )
    def operator_profile(spark, sf_dir):
        x = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, operators)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("operator"), (F.col("p_size") * 7 - 20).alias("window"))
        x = x.withColumn("traits", e.operator_traits(F.col("operator"), F.col("window")))
        return x.select("p_partkey", "operator", *[e.rnd(F.get("traits", F.lit(k))).alias(t) for k, t in enumerate(added)])

    vectors = [(name, *e.FIELDS[name][1], *[float(e.FIELDS[name][0] == kind) for kind in ("price_ts", "volume_ts", "crosssec")]) for name in e.FIRST_BATCH]
    eight = [f"v{k}" for k in range(8)]

    @catalog.query(
        "encoded_redundancy",
        f"""with r(field, {", ".join(eight)}) as (values {_values(vectors)}), v as (select field, [{", ".join(eight)}] as v from r), c as (select list_cosine_similarity(a.v, b.v) as cosine from v a join v b on a.field < b.field)
        select count(*) filter (where cosine >= 0.92) as redundant_pairs, round(count(*) filter (where cosine >= 0.92) / 28.0::double, 6) as redundancy_ratio, count(*) filter (where cosine >= 0.92) / 28.0::double < 0.6 as redundancy_pass from c""",
    )
    def encoded_redundancy(spark, sf_dir):
        x = e.encode_fields(spark.createDataFrame([(name,) for name in e.FIRST_BATCH], "field string")).select("field", "vector")
        return e.redundancy_report(led.redundant_fields(x), len(e.FIRST_BATCH))

    known = [(name, *e.FIELDS.get(name, e.FIELDS[e.UNKNOWN])[1]) for name in NAMES]

    @catalog.query(
        "formula_profile",
        f"""with f as (select distinct list_extract({NAMES}, (p_partkey % 10 + 1)::int) as a, list_extract({NAMES}, (p_size % 10 + 1)::int) as b from part), n(name, {traits}) as (values {_values(known)})
        select 'Sub(Add($' || a || ',$' || b || '),Mean($' || a || ',5))' as expression, {", ".join(f"round((2 * x.{t} + y.{t}) / 3, 6) as {t}" for t in e.TRAITS)} from f join n x on a = x.name join n y on b = y.name""",
    )
    def formula_profile(spark, sf_dir):
        name = lambda c: F.element_at(F.array(*map(F.lit, NAMES)), (F.col(c) % 10 + 1).cast("int"))
        a, b = name("p_partkey"), name("p_size")
        text = F.concat(F.lit("Sub(Add($"), a, F.lit(",$"), b, F.lit("),Mean($"), a, F.lit(",5))"))
        return e.formula_traits(table(spark, sf_dir, "part").select(text.alias("expression")))

    @catalog.query("stop_conditions", f"select * from (values {_values(STOP_CONDITIONS)}) v(check_id, stop_condition, required_output)")
    def stop_conditions(spark, sf_dir):
        return spark.createDataFrame(STOP_CONDITIONS, "check_id string, stop_condition string, required_output string")
