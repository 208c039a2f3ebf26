"""Fields as points: what kind of series a field is, and how much momentum, size, value, volatility and turnover it carries.

Everything is a projection over a column of names: no join, no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.numeric import steady_round as rnd

TRAITS = ("momentum", "size", "value", "volatility", "turnover")

# Kind of series and traits, in the order above, of plain fields (survey G14).
FIELDS = {
    "open": ("price_ts", (0.55, 0.10, 0.20, 0.20, 0.05)),
    "high": ("price_ts", (0.45, 0.10, 0.15, 0.65, 0.05)),
    "low": ("price_ts", (0.20, 0.05, 0.70, 0.45, 0.05)),
    "close": ("price_ts", (0.70, 0.10, 0.20, 0.25, 0.05)),
    "vwap": ("price_ts", (0.45, 0.35, 0.25, 0.25, 0.45)),
    "volume": ("volume_ts", (0.10, 0.75, 0.10, 0.35, 0.85)),
    "amount": ("volume_ts", (0.25, 0.85, 0.15, 0.30, 0.70)),
    "turnover_rate": ("crosssec", (0.15, 0.65, 0.10, 0.40, 0.95)),
    "turnover_ratio": ("crosssec", (0.15, 0.65, 0.10, 0.40, 0.95)),
    "ret": ("price_ts", (0.60, 0.05, 0.10, 0.65, 0.10)),
    "amtm": ("price_ts", (0.70, 0.10, 0.20, 0.25, 0.05)),
    "return_1d": ("price_ts", (0.55, 0.05, 0.10, 0.65, 0.10)),
    "return_5d": ("price_ts", (0.62, 0.05, 0.12, 0.55, 0.08)),
    "return_20d": ("price_ts", (0.70, 0.10, 0.18, 0.35, 0.06)),
    "rps_rank": ("crosssec", (0.82, 0.10, 0.10, 0.20, 0.20)),
    "rps_score": ("crosssec", (0.82, 0.10, 0.10, 0.20, 0.20)),
    "rps_slope_3d": ("crosssec", (0.70, 0.05, 0.10, 0.45, 0.35)),
    "money_flow": ("crosssec", (0.35, 0.65, 0.10, 0.35, 0.75)),
    "f9_quantile_250d": ("crosssec", (0.25, 0.25, 0.15, 0.35, 0.55)),
    "crowding": ("crosssec", (0.25, 0.25, 0.15, 0.35, 0.55)),
    "overnight": ("crosssec", (0.35, 0.05, 0.10, 0.60, 0.25)),
    "low_20": ("price_ts", (0.25, 0.05, 0.70, 0.45, 0.05)),
    "high_20": ("price_ts", (0.45, 0.05, 0.15, 0.65, 0.05)),
    "price_pos": ("crosssec", (0.65, 0.05, 0.20, 0.35, 0.10)),
    "rps_enhanced": ("crosssec", (0.85, 0.12, 0.10, 0.22, 0.22)),
    "rps_rank_enhanced": ("crosssec", (0.85, 0.12, 0.10, 0.22, 0.22)),
    "market_trend_eff": ("market_state_ts", (0.78, 0.05, 0.10, 0.25, 0.04)),
    "market_trend_state": ("market_state_ts", (0.82, 0.05, 0.10, 0.20, 0.03)),
    "market_breadth_state": ("market_state_ts", (0.65, 0.05, 0.12, 0.35, 0.05)),
    "market_vol_state": ("market_state_ts", (0.18, 0.05, 0.18, 0.92, 0.05)),
    "stock_trend_eff": ("state_ts", (0.82, 0.05, 0.10, 0.25, 0.06)),
    "stock_trend_state": ("state_ts", (0.85, 0.05, 0.10, 0.22, 0.05)),
    "stock_trend_slope": ("state_ts", (0.74, 0.05, 0.10, 0.42, 0.18)),
    "stock_price_position_state": ("state_ts", (0.62, 0.05, 0.32, 0.34, 0.08)),
    "float_share": ("capacity_crosssec", (0.05, 0.95, 0.22, 0.05, 0.30)),
    "total_share": ("capacity_crosssec", (0.05, 0.98, 0.20, 0.05, 0.25)),
    "market_cap": ("capacity_crosssec", (0.10, 0.98, 0.35, 0.08, 0.28)),
    "float_market_cap": ("capacity_crosssec", (0.10, 0.96, 0.35, 0.08, 0.38)),
    "float_market_cap_yuan": ("capacity_crosssec", (0.10, 0.96, 0.35, 0.08, 0.38)),
    "market_cap_billion": ("capacity_crosssec", (0.10, 0.98, 0.35, 0.08, 0.28)),
    "float_market_cap_billion": ("capacity_crosssec", (0.10, 0.96, 0.35, 0.08, 0.38)),
    "final_total_market_cap": ("capacity_crosssec", (0.10, 0.99, 0.35, 0.08, 0.28)),
    "final_total_market_cap_billion": ("capacity_crosssec", (0.10, 0.99, 0.35, 0.08, 0.28)),
    "final_float_market_cap": ("capacity_crosssec", (0.10, 0.97, 0.35, 0.08, 0.40)),
    "final_float_market_cap_billion": ("capacity_crosssec", (0.10, 0.97, 0.35, 0.08, 0.40)),
    "tdxgp_total_market_cap": ("capacity_crosssec", (0.10, 0.98, 0.35, 0.08, 0.28)),
    "tdxgp_total_market_cap_billion": ("capacity_crosssec", (0.10, 0.98, 0.35, 0.08, 0.28)),
    "market_cap_conflict_gt5pct": ("data_quality_event", (0.02, 0.45, 0.05, 0.50, 0.10)),
}
ALIASES = {"volt": "volume", "vrat": "turnover_rate", "mbrd": "vwap", "arat": "amount", "pldn": "low"}
UNKNOWN = "close"
FIRST_BATCH = ("open", "high", "low", "close", "volume", "vwap", "turnover_rate", "amount")

# Traits of statement fields by what their name holds, first match first; the last is for the rest.
STATEMENT = "fund_"
STATEMENTS = (
    ("debt|goodwill|inventory", (0.05, 0.15, 0.70, 0.45, 0.05)),
    ("total_assets|total_operate_income|total_shares", (0.05, 0.85, 0.25, 0.15, 0.03)),
    ("netprofit|ocf|cash|current_ratio|research|margin", (0.20, 0.25, 0.75, 0.20, 0.04)),
    ("holder|float_share|circulate", (0.15, 0.35, 0.45, 0.25, 0.06)),
    ("", (0.10, 0.35, 0.55, 0.25, 0.05)),
)

# Event fields with a family of their own (survey A1).
EVENTS = {
    "limit_close": "limit_up_close_event limit_down_close_event",
    "limit_open": "limit_up_open_event limit_down_open_event",
    "limit_touch": "limit_up_touch_event limit_down_touch_event",
    "limit_break": "limit_up_touch_not_close limit_down_touch_not_close",
    "limit_open_break": "limit_up_open_not_close limit_down_open_not_close",
    "limit_close_without_open": "limit_up_close_not_open limit_down_close_not_open",
    "limit_reason_record": "reason_record_exists",
    "open_board_record": "open_board_record",
    "limit_data_quality": "close_limit_without_reason_record reason_record_without_close_limit",
    "limit_streak_vendor": "limit_up_keep_times_vendor",
    "limit_seal_flow": "seal_money seal_rate seal_circulation_rate",
    "event_capacity": "actual_circulation_value",
    "event_liquidity": "turnover_ratio_real",
    "theme_plate": "plate_score",
    "high_board": "high_board_rank market_high_board is_market_high_board streak_gap_to_market_high",
}
# Event fields with a number in their name, as patterns, and the family that words in the name give, first match first.
NUMBERED_EVENTS = (
    r"limit_(up|down)_event",
    r"limit_(up|down)_streak(_close|_touch)?",
    r"limit_up_break|limit_down_repair|limit_flip_up_to_down|limit_flip_down_to_up",
    r"limit_(up|down)_(touch_)?streak_ge_([1-9]|10)",
    r"(break_board|limit_down_rebound)_after_streak_ge_([1-9]|10)",
    r"limit_up_(close|open|touch|open_not_close|touch_not_close|close_not_open)_count_t([2-9]|10)",
    r"limit_up_any_(open_not_close|close_not_open)_in_t([2-9]|10)",
    r"(post_market_high_board|break_after_high_board)_tplus_[1235]",
)
NUMBERED_FAMILIES = (
    ("count_t|any_", "limit_event_count"),
    ("high_board", "high_board"),
    ("down_rebound|down_repair", "limit_down_repair"),
    ("streak", "limit_streak"),
    ("break", "limit_break"),
    ("", "limit_close"),
)
# Traits of event families (survey A2); the last is for the rest.
EVENT_TRAITS = (
    ("limit_close limit_touch limit_open limit_reason_record", (0.78, 0.05, 0.05, 0.78, 0.38)),
    ("limit_break limit_open_break limit_close_without_open open_board_record", (0.42, 0.05, 0.18, 0.92, 0.50)),
    ("limit_streak limit_streak_vendor", (0.86, 0.05, 0.04, 0.82, 0.30)),
    ("limit_seal_flow", (0.68, 0.55, 0.04, 0.80, 0.50)),
    ("event_capacity", (0.08, 0.92, 0.25, 0.15, 0.25)),
    ("event_liquidity", (0.25, 0.65, 0.05, 0.55, 0.85)),
    ("theme_plate", (0.62, 0.15, 0.04, 0.65, 0.42)),
    ("limit_data_quality", (0.05, 0.05, 0.05, 0.40, 0.05)),
    ("high_board", (0.88, 0.08, 0.02, 0.86, 0.34)),
    ("limit_down_repair", (0.55, 0.05, 0.45, 0.90, 0.42)),
    ("", (0.55, 0.05, 0.12, 0.80, 0.40)),
)
ACROSS = ("high_board", "limit_density")

# Operators that may stand in a field's name, the words for them, and the field they take if none is named.
DERIVED = {"Mean": ("ma|mean", "close"), "Mom": ("mom|momentum", "close"), "Std": ("std|vol", "ret"), "Delay": ("delay|lag", "close")}
LONGEST = 252
# What operators add to the five traits and to decay, and what a full window adds beyond it (survey A3).
OPERATORS = (
    ("mean ma tsmean", (0.10, 0.0, 0.05, -0.10, -0.35, 0.35), (0.0, 0.0, 0.0, 0.0, -0.25, 0.45)),
    ("mom", (0.35, 0.0, -0.05, 0.05, 0.05, 0.05), None),
    ("std", (0.0, 0.0, 0.0, 0.45, 0.05, 0.10), None),
    ("delay delta", (0.05, 0.0, 0.0, 0.05, 0.10, 0.05), None),
)


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _first(tests: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first test that holds."""
    found = None
    for test, value in tests:
        found = F.when(test, value) if found is None else found.when(test, value)
    return found if otherwise is None else found.otherwise(otherwise)


def _plain(field: Column) -> Column:
    return F.regexp_replace(F.lower(field), r"^\$+", "")


def event_family(field: Column) -> Column:
    """The family of an event field; NULL where the name isn't an event's or is NULL."""
    name = _plain(field)
    named = [(name.isin(fields.split()), F.lit(family)) for family, fields in EVENTS.items()]
    numbered = _first([(name.rlike(words), F.lit(family)) for words, family in NUMBERED_FAMILIES])
    return _first([*named, (name.rlike(rf"\A(?:{'|'.join(NUMBERED_EVENTS)})\z"), numbered)])


def event_traits(family: Column) -> Column:
    """The five traits of an event family; NULL for NULL."""
    *known, (_, rest) = EVENT_TRAITS
    return F.when(family.isNotNull(), _first([(family.isin(names.split()), _numbers(v)) for names, v in known], _numbers(rest)))


def operator_traits(operator: Column, window: Column | None = None) -> Column:
    """What an operator adds to the five traits and to decay; nothing for operators without a profile. Windows end at 1 and 252."""
    span = F.least(F.greatest(F.coalesce(window if window is not None else F.lit(1), F.lit(1)), F.lit(1)), F.lit(LONGEST)) / F.lit(float(LONGEST))
    share = lambda base, more: _numbers(base) if more is None else F.array(*[F.lit(b) + F.lit(m) * span for b, m in zip(base, more, strict=True)])
    return _first([(F.lower(operator).isin(names.split()), share(base, more)) for names, base, more in OPERATORS], _numbers([0.0] * 6))


def derived_parts(field: Column) -> Column:
    """A field's name as (base, operator, window), where the name says an operator; otherwise NULL."""
    name = _plain(field)
    words = "|".join(w for w, _ in DERIVED.values())
    shape = rf"\A(?:([a-z][a-z0-9]*)_)?({words})_?([0-9]+)\z"
    word, digits = F.regexp_extract(name, shape, 2), F.regexp_replace(F.regexp_extract(name, shape, 3), "^0+", "")
    operator = _first([(word.isin(ws.split("|")), F.lit(op)) for op, (ws, _) in DERIVED.items()])
    usual = _first([(word.isin(ws.split("|")), F.lit(base)) for ws, base in DERIVED.values()])
    window = F.when(F.length(digits) > 3, F.lit(LONGEST)).otherwise(F.least(F.greatest(F.coalesce(digits.try_cast("int"), F.lit(1)), F.lit(1)), F.lit(LONGEST)))
    return F.when(name.rlike(shape), F.struct(F.coalesce(F.nullif(F.regexp_extract(name, shape, 1), F.lit("")), usual).alias("base"), operator.alias("operator"), window.alias("window")))


def _moved(traits: Column, operator: Column, window: Column) -> Column:
    step = F.slice(operator_traits(operator, window), 1, len(TRAITS))
    return F.zip_with(traits, step, lambda a, b: rnd(F.least(F.greatest(a + b, F.lit(0.0)), F.lit(1.0))))


def encode_fields(fields: DataFrame, field: str = "field") -> DataFrame:
    """Each row with its field's field_name, field_type, traits (five), vector (eight) and canonical_name.

    The vector is the traits and whether the series is a price, a volume or a cross-section.
    A name is an event, else a derived field, else a statement field, else a known one or an
    alias; unknown and NULL names are encoded as the close and have no canonical name.
    Equal rows stay equal rows; an empty table gives an empty one.
    """
    table = F.create_map(*[x for name, (kind, traits) in FIELDS.items() for x in (F.lit(name), F.struct(F.lit(kind).alias("kind"), _numbers(traits).alias("traits")))])
    other = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    x = fields.withColumn("_e", F.struct(_plain(F.col(field)).alias("name"), event_family(F.col(field)).alias("family")))
    # A base has no underscore, so it may be derived itself (ma5_mean_3), and its own base may not.
    x = x.withColumn("_d", F.when(F.col("_e.family").isNull(), derived_parts(F.col("_e.name")))).withColumn("_b", derived_parts(F.col("_d.base")))
    root = F.coalesce(F.col("_b.base"), F.col("_d.base"), F.col("_e.name"))
    x = x.withColumn("_r", F.coalesce(F.try_element_at(other, root), root)).withColumn("_k", F.try_element_at(table, F.col("_r")))
    statement = F.col("_e.family").isNull() & F.col("_d").isNull() & F.startswith(F.col("_e.name"), F.lit(STATEMENT))
    x = x.withColumn("_s", F.when(statement, _first([(F.col("_e.name").rlike(words), _numbers(v)) for words, v in STATEMENTS])))
    kind, traits = FIELDS[UNKNOWN]
    x = x.withColumn("_p", F.coalesce(F.col("_k.traits"), _numbers(traits))).withColumn("_t", F.coalesce(F.col("_k.kind"), F.lit(kind)))
    x = x.withColumn("_p", F.when(F.col("_b").isNotNull(), _moved(F.col("_p"), F.col("_b.operator"), F.col("_b.window"))).otherwise(F.col("_p")))
    x = x.withColumn("_p", F.when(F.col("_d").isNotNull(), _moved(F.col("_p"), F.col("_d.operator"), F.col("_d.window"))).otherwise(F.col("_p")))
    x = x.withColumn("_p", F.coalesce(event_traits(F.col("_e.family")), F.col("_s"), F.col("_p")))
    base_kind = F.when(F.col("_b").isNotNull(), F.concat(F.lit("derived_"), F.col("_t"))).otherwise(F.col("_t"))
    field_type = (
        F.when(F.col("_e.family").isin(*ACROSS), "event_crosssec")
        .when(F.col("_e.family").isNotNull(), "event_ts")
        .when(F.col("_d").isNotNull(), F.concat(F.lit("derived_"), base_kind))
        .when(F.col("_s").isNotNull(), "fundamental_crosssec")
        .otherwise(F.col("_t"))
    )
    spelled = F.concat_ws("_", F.col("_d.base"), F.lower(F.col("_d.operator")), F.col("_d.window").cast("string"))
    own = F.col("_e.family").isNotNull() | F.col("_s").isNotNull()
    x = x.withColumn("field_type", field_type)
    # A derived field has the flags of its base, whatever stands before the kind.
    flag = lambda word: F.when(F.col("_d").isNotNull(), F.endswith(F.col("field_type"), F.lit(word))).otherwise(F.col("field_type") == word).cast("double")
    flags = F.when(own, F.array(F.lit(0.0), F.lit(0.0), F.col("field_type").isin("event_crosssec", "fundamental_crosssec").cast("double"))).otherwise(F.array(flag("price_ts"), flag("volume_ts"), flag("crosssec")))
    out = {
        "field_name": F.when(own, F.col("_e.name")).when(F.col("_d").isNotNull(), spelled).otherwise(F.when(F.col("_k").isNotNull(), F.col("_r")).otherwise(F.lit(UNKNOWN))),
        "traits": F.col("_p"),
        "vector": F.concat(F.col("_p"), flags),
        "canonical_name": F.when(own, F.col("_e.name")).when(F.col("_k").isNotNull(), F.when(F.col("_d").isNotNull(), spelled).otherwise(F.col("_r"))),
    }
    return x.withColumns(out).drop("_e", "_d", "_b", "_r", "_k", "_s", "_p", "_t")


def formula_traits(formulas: DataFrame, expression: str = "expression") -> DataFrame:
    """The mean traits of a formula's fields, each as often as it stands there; without fields the close's.

    A derived field counts as the field it is made of. One row a formula text.
    """
    # As everywhere in these columns: repeats count, so no set is built.
    name = F.explode(F.when(F.size("_f") > 0, F.col("_f")).otherwise(F.array(F.lit(UNKNOWN)))).alias("_name")
    x = formulas.select(expression).distinct().select(expression, F.expr(f"regexp_extract_all({expression}, '[$]([A-Za-z0-9_]+)', 1)").alias("_f")).select(expression, name)
    x = x.withColumn("_name", F.coalesce(derived_parts(F.col("_name"))["base"], F.col("_name")))
    x = encode_fields(x, "_name")
    return x.groupBy(expression).agg(*[rnd(F.avg(F.get("traits", F.lit(k)))).alias(t) for k, t in enumerate(TRAITS)])


def redundancy_report(pairs: DataFrame, fields: int) -> DataFrame:
    """How many of the pairs of so many fields are redundant; fewer than 0.6 of them pass. One row."""
    possible = max(1, fields * (fields - 1) // 2)
    ratio = rnd(F.count("*") / F.lit(float(possible)))
    return pairs.agg(F.count("*").alias("redundant_pairs"), ratio.alias("redundancy_ratio"), (ratio < 0.60).alias("redundancy_pass"))
