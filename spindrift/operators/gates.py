"""What may be evaluated: classes of fields, and verdicts on formula texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of operators and of kinds of fields, tested in order. A test is (how, words).
ORDINARY = "Mean Std Delta Delay Wma Med Kurt Skew ZScore Mom Corr Cov CSResidual Div Log".split()
TYPED = "EventAge SinceLastEvent EventCount EventTransition StateAge StateDwell StateTransition WindowStateCount ValidRatioGate MaskedCorr MaskedZScore SafeCSResidual".split()
ALWAYS_UNSAFE = "CSResidual Corr Cov Std Delta Delay".split()
COVERAGE_GUARDED = "Corr Cov ZScore CSResidual".split()
EVENT_REWRITE = "EventCount|EventAge|EventTransition|StateDwell|WindowStateCount"
COVERAGE_REWRITE = "ValidRatioGate|MaskedCorr|MaskedZScore|SafeCSResidual"
CATEGORIES: list[tuple[str, list[tuple[str, str]]]] = [
    ("text_or_label", [("has", "future label next_open next_close next_return")]),
    ("timestamp_or_key", [("ends", "cutoff_minute _time_minute"), ("is", "code symbol date trade_date trade_time notice_date report_date update_time")]),
    ("membership_or_group_key", [("has", "industry sector plate concept board_code theme")]),
    ("coverage_sensitive", [("starts", "ctx_")]),
    ("sparse_event", [("has", "limit uplimit open_board break_board fengdan auction seal")]),
    ("discrete_state", [("has", "is_ streak lb_ max_lb hotness rank dwell state")]),
    (
        "coverage_sensitive",
        [("is", "pe pb ps pe_ttm pb_mrq ps_ttm volume_ratio turnover_ratio"), ("starts", "fund_"), ("has", "rzrq rzye billboard holder market_cap float_share total_share fundamental")],
    ),
    ("firstn_minute_derived", [("starts", "m1_first")]),
    ("continuous_minute", [("is", "pct_chg amplitude_pct change pre_close vol"), ("has", "open high low close vwap amount volume ret range")]),
]
DEFAULT_CATEGORY = "coverage_sensitive"
EVENT_FIELDS = "evt_uplimit_active evt_uplimit_age_min evt_uplimit_amount evt_uplimit_fd_close evt_uplimit_fd_max evt_uplimit_type_code evt_uplimit_up_limit_keep_times"
DIRECT_FIELDS = "open high low close vol volume amount amount_yuan vwap pct_chg ret_1m intraday_ret_from_open"
LANES: list[tuple[str, list[tuple[str, str]]]] = [
    ("blocked_key_or_label", [("is", "code date exec_date trade_time signal_time evt_uplimit_cutoff_minute"), ("ends", "_bars cutoff_minute _time_minute"), ("has", "next_open next_close next_return label future")]),
    ("lagged_context", [("starts", "ctx_")]),
    ("event_state", [("is", EVENT_FIELDS), ("has", "limit uplimit open_board break_board high_board lb_ auction fengdan seal")]),
    ("direct_formula", [("starts", "m1_first"), ("is", DIRECT_FIELDS)]),
    ("lagged_context", [("has", "rzrq billboard holder fund_ hfq_")]),
    ("membership_context", [("has", "industry sector plate concept theme board_code")]),
]
DEFAULT_LANE = "unknown_review"


def _test(name: Column, how: str, words: str) -> Column:
    listed = words.split()
    if how == "is":
        return name.isin(listed)
    each = {"has": lambda w: F.contains(name, F.lit(w)), "ends": lambda w: F.endswith(name, F.lit(w)), "starts": lambda w: F.startswith(name, F.lit(w))}[how]
    return reduce(lambda a, b: a | b, map(each, listed))


def classify(name: Column, rules: list, default: str) -> Column:
    """The first class any of whose tests the name meets."""
    out = None
    for label, tests in rules:
        met = reduce(lambda a, b: a | b, (_test(name, how, words) for how, words in tests))
        out = F.when(met, label) if out is None else out.when(met, label)
    return out.otherwise(default)


def field_category(field: Column) -> Column:
    return classify(F.ltrim(F.lower(field), F.lit("$")), CATEGORIES, DEFAULT_CATEGORY)


def field_lane(field: Column) -> Column:
    return classify(F.ltrim(F.lower(F.trim(field)), F.lit("$")), LANES, DEFAULT_LANE)


def formula_fields(text: Column) -> Column:
    """Names of the fields in a formula, lower case, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\$([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.lower))


def sorted_fields(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))


def primitives_in(text: Column, names: list[str]) -> Column:
    """Those of the operators that a text calls, by exact name."""
    return F.filter(F.array(*map(F.lit, names)), lambda p: F.rlike(text, F.concat(F.lit(r"\b"), p, F.lit(r"\s*\("))))


def typed_gate(formulas: DataFrame, column: str = "expression") -> DataFrame:
    """Each formula with a verdict, and which fields and operators it is about.

    The test is one of text and errs on the safe side: once a sparse or discrete field is
    there, some operators block the formula wherever they stand in it.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    out = formulas.withColumns({"__fields": formula_fields(text), "__ordinary": primitives_in(text, ORDINARY), "__typed": primitives_in(text, TYPED)})
    of = lambda *kinds: F.filter("__fields", lambda f: field_category(f).isin(*kinds))
    out = out.withColumns({"__label": of("timestamp_or_key", "text_or_label"), "__member": of("membership_or_group_key"), "__sparse": of("sparse_event", "discrete_state"), "__covered": of("coverage_sensitive")})
    inside = lambda p: F.exists("__sparse", lambda f: F.rlike(text, F.concat(F.lit(r"(?i)\b"), p, F.lit(r"\s*\([^)]*\$"), f, F.lit(r"\b"))))
    out = out.withColumn("__offending", F.array_sort(F.filter("__ordinary", inside)))
    out = out.withColumn("__guarded", F.array_intersect("__ordinary", F.array(*map(F.lit, COVERAGE_GUARDED))))
    none = F.size("__fields") == 0
    some = lambda c: F.size(c) > 0
    unsafe = some("__offending") | F.arrays_overlap("__ordinary", F.array(*map(F.lit, ALWAYS_UNSAFE)))
    label_text = F.lower(text).rlike("future|label|next_")
    cases = [
        (none & label_text, "reject_label_or_future_field", None, None, ""),
        (none, "allow", None, None, ""),
        (some("__label"), "reject_label_or_future_field", "__label", "__ordinary", ""),
        (some("__member"), "reject_membership_key_formula_input", "__member", "__ordinary", ""),
        (some("__sparse") & some("__ordinary") & unsafe, "blocked_unsafe_known_structure", "__sparse", "__unsafe", EVENT_REWRITE),
        (some("__sparse") & some("__ordinary"), "require_typed_rewrite", "__sparse", "__ordinary", EVENT_REWRITE),
        (some("__sparse") & (F.size("__typed") == 0), "require_typed_rewrite", "__sparse", "__ordinary", EVENT_REWRITE),
        (some("__covered") & some("__guarded") & (F.size("__typed") == 0), "require_typed_rewrite", "__covered", "__guarded", COVERAGE_REWRITE),
    ]
    out = out.withColumn("__unsafe", F.when(some("__offending"), F.col("__offending")).otherwise(F.col("__ordinary")))
    verdict = None
    for test, decision, fields, primitives, rewrite in cases:
        value = F.struct(
            F.lit(decision).alias("typed_gate_decision"),
            (F.array_join(fields, "|") if fields else F.lit("")).alias("blocked_fields"),
            (F.array_join(primitives, "|") if primitives else F.lit("")).alias("blocked_primitives"),
            F.lit(rewrite).alias("required_rewrite"),
        )
        verdict = F.when(test, value) if verdict is None else verdict.when(test, value)
    allow = F.struct(F.lit("allow").alias("typed_gate_decision"), *[F.lit("").alias(c) for c in ("blocked_fields", "blocked_primitives", "required_rewrite")])
    return out.withColumn("__v", verdict.otherwise(allow)).select(*formulas.columns, "__v.*")


def split_by_gate(formulas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed, rejected); a rejection from upstream stays one."""
    judged = typed_gate(formulas)
    upstream = F.coalesce(F.col("upstream_rejection"), F.lit("")) != "" if "upstream_rejection" in formulas.columns else F.lit(False)
    allowed = (F.col("typed_gate_decision") == "allow") & ~upstream
    return judged.where(allowed), judged.where(~allowed)


RELATIONS = "corr cov csresidual maskedcorr safecsresidual".split()
ROLLINGS = "mean std delta delay wma med kurt skew mom eventcount statedwell windowstatecount validratiogate maskedzscore".split()


def nesting(text: Column) -> Column:
    """The deepest parenthesis."""
    chars = F.split(F.regexp_replace(text, r"[^()]", ""), "")
    walked = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda s, c: F.struct(
            F.greatest(s["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0), F.lit(0)).alias("now"),
            F.greatest(s["top"], s["now"] + F.when(c == "(", 1).otherwise(0)).alias("top"),
        ),
        lambda s: s["top"],
    )
    return walked


def cost_report(formulas: DataFrame, column: str = "expression") -> DataFrame:
    """Operators, depth, length, an estimated cost, and the lane it puts a formula in."""
    text = F.trim(F.col(column))
    calls = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z0-9_]*)\s*\("), F.lit(1)), F.lower)
    count = lambda names: F.size(F.filter("__calls", lambda c: c.isin(names)))
    out = formulas.withColumns({"__calls": calls, "max_parenthesis_depth": nesting(text), "expression_length": F.length(text)})
    out = out.withColumns({"operator_count": F.size("__calls"), "relation_operator_count": count(RELATIONS), "rolling_operator_count": count(ROLLINGS)})
    relations, rollings = F.col("relation_operator_count"), F.col("rolling_operator_count")
    lane = (
        F.when((relations == 0) & (rollings <= 4), "cheap_fast_path")
        .when((relations <= 2) & (rollings <= 8), "moderate_fast_path")
        .when(relations <= 8, "slow_relation_path")
        .otherwise("very_slow_nested_relation_path")
    )
    score = F.col("expression_length") / 50.0 + rollings * 2.0 + relations * 8.0 + F.col("max_parenthesis_depth") * 1.5
    role = F.when(text.rlike(r"^\s*Sign\s*\("), "group_spread_regime_shadow").otherwise("cross_sectional_rank_validation")
    return out.withColumns({"validation_lane": lane, "validation_role": role, "estimated_cost": score}).drop("__calls")


KNOWN = "Add Sub Mul Div Abs Sign Log Neg CSRank ZScore CSResidual Mean Std Mom Delay Delta Wma Med Kurt Skew Corr Cov".split() + TYPED
BINS = {"depth": (2, 4, 6, 8), "opcount": (3, 6, 9, 12), "fieldcount": (1, 2, 4, 6), "wincount": (0, 1, 2, 4), "maxwin": (0, 5, 15, 30, 60), "complexity": (6, 10, 14, 18)}


def binned(value: Column, prefix: str) -> Column:
    edges = BINS[prefix]
    out = F.when(value <= edges[0], f"{prefix}_le_{edges[0]}")
    for e in edges[1:]:
        out = out.when(value <= e, f"{prefix}_le_{e}")
    return out.otherwise(f"{prefix}_gt_{edges[-1]}")


def shape_features(formulas: DataFrame, column: str = "expression") -> DataFrame:
    """A formula's outline, its operators, and binned sizes."""
    text = F.coalesce(F.col(column), F.lit(""))
    calls = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda c: c.isin(KNOWN))
    windows = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r",\s*(\d+)\s*\)"), F.lit(1)), lambda w: w.try_cast("int")), lambda w: w.between(1, 252))))
    outline = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\$[A-Za-z_][A-Za-z0-9_]*", r"\$F"), r"\b\d+(?:\.\d+)?\b", "N"), r"\s+", "")
    out = formulas.withColumns({"__calls": calls, "__windows": windows, "__fields": sorted_fields(text), "ast_depth": nesting(text), "ast_skeleton": F.substring(outline, 1, 240)})
    tally = F.transform(F.array_sort(F.array_distinct("__calls")), lambda c: F.concat(c, F.lit(":"), F.size(F.filter("__calls", lambda d: d == c)).cast("string")))
    or_none = lambda c: F.when(c == "", "none").otherwise(c)
    sizes = {"ast_operator_count": F.size("__calls"), "ast_field_count": F.size("__fields"), "ast_window_count": F.size("__windows"), "ast_max_window": F.coalesce(F.array_max("__windows"), F.lit(0))}
    out = out.withColumns(
        {
            "ast_operator_sequence": or_none(F.array_join(F.slice("__calls", 1, 10), ">")),
            "ast_operator_multiset": or_none(F.array_join(tally, "|")),
            "ast_root_operator": F.coalesce(F.get("__calls", F.lit(0)), F.lit("none")),
            **sizes,
        }
    )
    out = out.withColumn("ast_complexity", F.col("ast_operator_count") + F.col("ast_field_count") + F.col("ast_window_count"))
    bins = {"ast_depth": "depth", "ast_operator_count": "opcount", "ast_field_count": "fieldcount", "ast_window_count": "wincount", "ast_max_window": "maxwin", "ast_complexity": "complexity"}
    return out.withColumns({f"{c}_bin": binned(F.col(c), p) for c, p in bins.items()}).drop("__calls", "__windows", "__fields")


def primitive_matrix(spark) -> DataFrame:
    """Which operator may take which kind of field: a fixed table of operators by kinds."""
    kinds = list(dict.fromkeys([c for c, _ in CATEGORIES] + [DEFAULT_CATEGORY]))
    rows = [(p, p in TYPED, k) for p in ORDINARY + TYPED for k in kinds]
    table = spark.createDataFrame(rows, "primitive string, typed boolean, category string")
    k, p = F.col("category"), F.col("primitive")
    decision = (
        F.when(k.isin("text_or_label", "timestamp_or_key"), "reject")
        .when(k == "membership_or_group_key", "reject_membership")
        .when(F.col("typed"), "allow_typed")
        .when(k.isin("sparse_event", "discrete_state"), F.when(p.isin(ALWAYS_UNSAFE), "block").otherwise("typed_rewrite"))
        .when((k == "coverage_sensitive") & p.isin(COVERAGE_GUARDED), "coverage_guard")
        .otherwise("allow")
    )
    return table.select("primitive", "category", decision.alias("decision"))


#: Risky phrases that a scan of texts looks for.
MOTIFS = {
    "ordinary_std_on_event": r"Std\([^)]*limit",
    "ordinary_corr_on_event": r"Corr\([^)]*limit",
    "delta_on_state": r"Delta\([^)]*(streak|rank)",
    "group_rank": r"Group(Rank|Neutralize)\(",
    "future_reference": r"next_(open|close|return)",
}


def scan_motifs(lines: DataFrame) -> DataFrame:
    """Rows (path, line_no, text, motif) of lines that hold a risky phrase; repeats once."""
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in MOTIFS.items()]))
    return lines.withColumn("motif", F.explode(found)).select("path", "line_no", "text", "motif").distinct()


def motif_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path", "motif").agg(F.count("*").alias("hits"), F.min("line_no").alias("first_line"))


BLOCKER_COLUMNS = ("blocker_flags", "decision", "note")
BLOCKER_TOKENS = "future_signal_wrong_lag|hard_reject|signal_corr_abs"


def hard_blocked(rows: DataFrame, columns: tuple[str, ...] = BLOCKER_COLUMNS) -> Column:
    """Whether any of the columns speaks of a hard blocker."""
    there = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in rows.columns]
    return F.lower(F.concat_ws("|", *there)).rlike(BLOCKER_TOKENS)


def feasible(candidates: DataFrame, available: list[str], turnover_cap: float = 0.75) -> DataFrame:
    """Candidates with what keeps them from being audited: missing fields, then too much turnover."""
    missing = F.array_except(sorted_fields(F.col("expression")), F.array(*map(F.lit, available)))
    out = candidates.withColumn("missing_fields", F.array_join(missing, "|"))
    status = F.when(F.col("missing_fields") != "", "missing_fields").when(F.col("mean_one_way_turnover") > turnover_cap, "turnover_proxy_above_cap").otherwise("pass")
    return out.withColumn("gate_status", status)


def formula_class(formulas: DataFrame, available: list[str], blocked: list[str], same_day: list[str]) -> DataFrame:
    """Blocked if any field is a key, forbidden or missing; else the strongest of diagnostic, event and context."""
    fields = formulas.select("expression", F.explode_outer(sorted_fields(F.col("expression"))).alias("field"))
    lane = field_lane(F.col("field"))
    per = fields.groupBy("expression").agg(
        F.bool_or((lane == "blocked_key_or_label") | F.col("field").isin(blocked)).alias("bad"),
        F.bool_or(~F.col("field").isin(available)).alias("gone"),
        F.bool_or(F.col("field").isin(same_day)).alias("day"),
        F.bool_or(lane == "event_state").alias("event"),
        F.bool_or(lane == "lagged_context").alias("context"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.when(yes("bad") | yes("gone"), "blocked").when(yes("day"), "diagnostic").when(yes("event"), "event").when(yes("context"), "context").otherwise("direct")
    return per.select("expression", kind.alias("formula_class"))


def memory_view(memory: DataFrame) -> DataFrame:
    """Every remembered formula judged again; one that fails keeps its key but earns no credit."""
    judged = typed_gate(memory)
    blocked = F.col("typed_gate_decision") != "allow"
    return judged.withColumns({"memory_status": F.when(blocked, "blocked").otherwise("kept"), "credit": F.when(~blocked, F.col("reward"))})


# What stops a typed canary, and the report that has to show that it didn't happen (survey A20). Conditions in our words.
STOP_CONDITIONS = [
    ("ce2_01_entry_path", "no candidate has a field of the event, state or coverage lanes that were asked for", "candidate_field_category_attribution.csv"),
    ("ce2_02_old_primitive_leak", "a blocked category is inside an ordinary primitive without its typed form", "typed_gate_violation.csv"),
    ("ce2_03_coverage_mask_alpha", "a field does no better than its coverage mask or its shuffled values", "coverage_placebo_audit.csv"),
    ("ce2_04_event_start_bias", "ages, counts and dwells move mainly where coverage or recording starts", "event_observable_boundary_audit.csv"),
    ("ce2_05_same_count_placebo", "event candidates do no better than as many random rows or matched controls", "event_state_placebo_audit.csv"),
    ("ce2_06_wrong_lag", "a wrong lag or a value not known that day does better than the right one", "lag_contract_audit.csv"),
    ("ce2_07_fragment_replay", "proxy metrics pass, the replay of fragments with costs and blocks of days doesn't", "fragment_replay_summary.csv"),
]
