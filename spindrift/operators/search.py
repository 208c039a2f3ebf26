"""Generating formulas: atoms, proposals made of them, and the arms that pick among proposals.

Proposals are tables. Atoms are few and listed on the driver; everything made of them
(transforms, products of event and state atoms, verdicts, scores, what memory has seen)
is one DataFrame plan. Only the final pick under caps walks a sorted list, as each row
depends on those before it.
"""

from __future__ import annotations

import logging
import math
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators.feedback import decide, policy_feedback, policy_score
from spindrift.operators.gates import LANES, sorted_fields, typed_gate
from spindrift.operators.joins import unseen
from spindrift.operators.selection import pick_capped

#: Fixed: added to divisors in formulas, and the windows that atoms use.
TINY = "0.000001"
WINDOWS = (2, 3, 5, 8, 10, 15, 20, 30)
CURVES = ((2, 5), (3, 8), (5, 15), (8, 20), (10, 30))
OPENINGS = tuple(f"m1_first{n}" for n in (5, 10, 15, 20, 30))


@dataclass(frozen=True)
class Atom:
    """A building block: its formula, what it says (an event or a state), and how it may be normalised."""

    name: str
    lane: str
    expr: str
    side: str
    mode: str
    role: str
    needs: tuple[str, ...]


def _over(a: str, b: str) -> str:
    return f"Div({a},Add(Abs({b}),{TINY}))"


def _less_mean(a: str) -> str:
    return f"Sub({a},Mean({a},{{w}}))"


_RANGE = _over("Sub($high,$low)", "$open")
_PLACE = _over("Sub($close,$low)", "Sub($high,$low)")
_STEP = _over("Sub($close,Delay($close,1))", "Delay($close,1)")
_PRE = _over("Sub($close,$pre_close)", "$pre_close")
_VWAP = _over("Sub($vwap,$open)", "$open")
#: Atoms with a window: name, lane, formula, side, fields.
_WINDOWED = [
    ("close_ret_delta_{w}", "rx_intraday_return", f"Delta({_STEP},{{w}})", "event", "close open high low"),
    ("range_vol_{w}", "rx_range_location", f"Std({_RANGE},{{w}})", "state", "open high low close"),
    ("bar_loc_shift_{w}", "rx_range_location", _less_mean(_PLACE), "event", "open high low close"),
    *[(f"{f}_delta_{{w}}", "rx_intraday_return", f"Delta(${f},{{w}})", "event", f) for f in ("ret_1m", "intraday_ret_from_open", "pct_chg", "change")],
    ("amplitude_pct_delta_{w}", "rx_range_location", "Delta($amplitude_pct,{w})", "event", "amplitude_pct"),
    ("pre_close_gap_shift_{w}", "rx_intraday_return", _less_mean(_PRE), "event", "close pre_close"),
    *[(f"{f}_delta_{{w}}", "rx_flow_amount_volume", f"Delta(${f},{{w}})", "state", f) for f in ("amount", "amount_yuan", "volume", "vol")],
    ("vwap_delta_{w}", "rx_intraday_price_location", "Delta($vwap,{w})", "state", "vwap"),
    ("vwap_open_gap_shift_{w}", "rx_intraday_price_location", _less_mean(_VWAP), "event", "open vwap"),
]
#: Atoms of two windows.
_CURVED = [(f"{f}_curve_{{s}}_{{l}}", "rx_intraday_price_location" if f == "vwap" else "rx_flow_amount_volume", _over(f"Mean(${f},{{s}})", f"Mean(${f},{{l}})"), "state", f) for f in ("amount", "amount_yuan", "volume", "vol", "vwap")]
#: Atoms of the first minutes; {p} is their prefix.
_OPENED = [
    ("{p}_amount", "rx_opening_amount", _over("${p}_amount", "$amount"), "event", "amount {p}_amount"),
    ("{p}_vol", "rx_opening_amount", _over("${p}_vol", "$volume"), "state", "volume {p}_vol"),
    ("{p}_range", "rx_opening_range", _over("${p}_range", "$open"), "event", "open {p}_range"),
    ("{p}_vwap_open", "rx_opening_divergence", "${p}_vwap_return_vs_open", "event", "{p}_vwap_return_vs_open"),
    ("{p}_actual_range", "rx_opening_range", _over("Sub(${p}_high,${p}_low)", "$open"), "event", "open {p}_high {p}_low"),
    ("{p}_last_return_vs_open", "rx_opening_divergence", "${p}_last_return_vs_open", "event", "{p}_last_return_vs_open"),
    ("{p}_vwap_gap_vs_open", "rx_opening_divergence", _over("Sub(${p}_vwap,$open)", "$open"), "event", "open {p}_vwap"),
    ("{p}_last_close_gap", "rx_opening_divergence", _over("Sub(${p}_last_close,$open)", "$open"), "event", "open {p}_last_close"),
]


def lane_of(field: str) -> str:
    """The lane of a field by name, for lists on the driver; columns use :func:`gates.field_lane`."""
    name = field.strip().lower().lstrip("$")
    tests: dict[str, Callable[[str], bool]] = {"is": lambda w: name == w, "has": lambda w: w in name, "ends": name.endswith, "starts": name.startswith}
    for lane, rules in LANES:
        if any(tests[how](w) for how, words in rules for w in words.split()):
            return lane
    return "unknown_review"


def build_atoms(available: Iterable[str]) -> list[Atom]:
    """All atoms whose fields are there; of equal formulas the first."""
    have = {f.lstrip("$") for f in available}
    found: list[Atom] = []

    def add(row: tuple, mode: str = "ordinary", role: str = "formula_search", **slots) -> None:
        fill = lambda t: t if not slots else _fill(t, slots)
        name, lane, expr, side, needs = row
        fields = tuple(fill(needs).split())
        if have.issuperset(fields):
            found.append(Atom(fill(name), lane, fill(expr), side, mode, role, fields))

    for row in _WINDOWED:
        for w in WINDOWS:
            add(row, w=w)
    for row in _CURVED:
        for s, long in CURVES:
            add(row, s=s, l=long)
    for p in OPENINGS:
        for row in _OPENED:
            add(row, p=p)
    for f in sorted(x for x in have if lane_of(x) == "event_state"):
        if f.endswith("_active"):
            pair = [(f"{f}_event_count_5", f"EventCount(${f},5)"), (f"{f}_event_age", f"EventAge(${f})")]
        else:
            pair = [(f"{f}_state_dwell_5", f"StateDwell(${f},5)"), (f"{f}_window_state_count_10", f"WindowStateCount(${f},10)")]
        for name, expr in pair:
            add((name, "event_state" if f.endswith("_active") else "state_lifecycle", expr, "event", f), "typed_rank", "event_state_search")
    for f in sorted(x for x in have if lane_of(x) == "lagged_context"):
        context = [(f"{f}_masked_zscore", f"MaskedZScore(${f},60,0.8)", f), (f"{f}_valid_ratio", f"ValidRatioGate(${f},60,0.8)", f), (f"{f}_safe_residual_amount", f"SafeCSResidual(${f},$amount,20,5,0.8)", f"{f} amount")]
        for name, expr, needs in context:
            add((name, "coverage_guarded_context", expr, "state", needs), "typed_rank", "lagged_context_search")
    return list({a.expr: a for a in reversed(found)}.values())[::-1]


def _fill(text: str, slots: dict) -> str:
    for key, value in slots.items():
        text = text.replace(f"{{{key}}}", str(value))
    return text


def atom_table(spark: SparkSession, available: Iterable[str]) -> DataFrame:
    rows = [{**asdict(a), "needs": list(a.needs)} for a in build_atoms(available)]
    return spark.createDataFrame(rows, "name string, lane string, expr string, side string, mode string, role string, needs array<string>")


def normalized(prefix: str = "") -> Column:
    """An atom brought to scale: typed atoms by rank, others by z-score."""
    expr = F.col(f"{prefix}expr")
    return F.when(F.col(f"{prefix}mode") == "typed_rank", F.concat(F.lit("CSRank("), expr, F.lit(")"))).otherwise(F.concat(F.lit("ZScore("), expr, F.lit(")")))


def _form(pattern: str, **parts: Column) -> Column:
    """A formula text with columns put into a pattern's {slots}."""
    pieces, rest = [], pattern
    while "{" in rest:
        before, _, tail = rest.partition("{")
        slot, _, rest = tail.partition("}")
        pieces += [F.lit(before), parts[slot]]
    return F.concat(*pieces, F.lit(rest))


def single(atoms: DataFrame, patterns: dict[str, str], family: str) -> DataFrame:
    """Proposals of one atom each; {n} is the atom brought to scale."""
    forms = [F.struct(F.lit(kind).alias("kind"), _form(p, n=normalized()).alias("expression")) for kind, p in patterns.items()]
    made = atoms.select("name", "lane", F.inline(F.array(*forms)))
    return made.select("expression", F.concat_ws("::", F.lit(family), "lane", "kind").alias("lane"), F.col("name").alias("note"))


def crossed(atoms: DataFrame, patterns: dict[str, str], family: str, most: int) -> DataFrame:
    """Proposals of an event and a state atom of different stems; {a} and {b} are brought to scale, {x} and {y} aren't.

    Either side is cut to the ``most`` best-ranked atoms first, so the product is bounded.
    """
    order = Window.partitionBy("side").orderBy(F.desc("rank_score"), F.desc("name"))
    best = atoms.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most)
    side = lambda which, p: best.where(F.col("side") == which).select(*[F.col(c).alias(p + c) for c in ("name", "lane", "expr", "mode")])
    stem = lambda c: F.substring_index(c, "_", 1)
    pairs = side("event", "l_").join(side("state", "r_"), stem("l_name") != stem("r_name"))
    forms = [F.struct(F.lit(kind).alias("kind"), _form(p, a=normalized("l_"), b=normalized("r_"), x=F.col("l_expr"), y=F.col("r_expr")).alias("expression")) for kind, p in patterns.items()]
    made = pairs.select("l_name", "r_name", "l_lane", "r_lane", F.inline(F.array(*forms)))
    return made.select("expression", F.concat_ws("::", F.lit(family), "l_lane", "r_lane", "kind").alias("lane"), F.concat_ws(" x ", "l_name", "r_name").alias("note"))


def expression_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def judged(proposals: DataFrame, policy: DataFrame, memory: DataFrame) -> DataFrame:
    """Allowed, unseen proposals, each formula once, with their scores."""
    hashed = proposals.withColumn("expression_hash", expression_hash(F.col("expression")))
    once = hashed.withColumn("__nth", F.row_number().over(Window.partitionBy("expression_hash").orderBy("lane", "note"))).where("__nth = 1").drop("__nth")
    allowed = typed_gate(unseen(once, memory)).where(F.col("typed_gate_decision") == "allow")
    scored = policy_score(allowed, policy)
    kept = allowed.select("expression_hash", "expression", "lane", "note", F.array_join(sorted_fields(F.col("expression")), "|").alias("fields"))
    return kept.join(scored, "expression_hash")


RANKS = {"rank": "CSRank({n})", "inverted": "Neg(CSRank({n}))"}
PRODUCTS = {"product": "CSRank(Mul({a},{b}))", "spread": "CSRank(Sub({a},{b}))"}
SLOW = {
    "smooth10": "CSRank(Mean({n},10))",
    "smooth20": "CSRank(Mean({n},20))",
    "delay3_smooth20": "CSRank(Delay(Mean({n},20),3))",
    "slow_change": "CSRank(Sub(Mean({n},30),Delay(Mean({n},30),5)))",
    "inverted_smooth20": "Neg(CSRank(Mean({n},20)))",
}
SLOW_PRODUCTS = {"slow_product": "CSRank(Mul(Delay(Mean({a},15),2),Mean({b},30)))", "slow_spread": "CSRank(Sub(Delay(Mean({a},15),2),Mean({b},30)))"}
SIGNED = {**PRODUCTS, "signed_state": "CSRank(Mul(Sign({a}),{b}))"}
RESAMPLED = {"elite_spread_mean3": "CSRank(Sub({a},Mean({b},3)))", "elite_delta_product": "CSRank(Mul(Delta({a},2),{b}))", "elite_inverted_product": "Neg(CSRank(Mul({a},{b})))"}


#: Ready-made formulas over named fields, by family; {f}, {g} are fields.
TEMPLATES = {
    "opening": (("CSRank(ZScore(Delta({f},5)))", "CSRank(Sub(ZScore({f}),Mean(ZScore({f}),10)))", "CSRank(Corr({f},{g},15))", "Neg(CSRank(Std({f},10)))"), "direct_formula"),
    "limit_motif": (("CSRank(EventCount({f},5))", "CSRank(EventAge({f}))", "CSRank(StateDwell({f},5))", "CSRank(WindowStateCount({f},10))"), "event_state"),
    "typed_context": (("CSRank(MaskedZScore({f},60,0.8))", "CSRank(ValidRatioGate({f},60,0.8))", "CSRank(MaskedCorr({f},{g},60,0.8))"), "lagged_context"),
    "low_turnover": (("CSRank(Mean(ZScore({f}),30))", "CSRank(Delay(Mean(ZScore({f}),20),5))", "CSRank(Sub(Mean({f},30),Delay(Mean({f},30),10)))"), "direct_formula"),
}


def templates(spark: SparkSession, available: Iterable[str]) -> DataFrame:
    """Proposals from the templates, for the fields of each family's lane; {g} is the lane's next field."""
    rows = []
    for family, (texts, lane) in TEMPLATES.items():
        own = sorted(f for f in available if lane_of(f) == lane)
        for k, f in enumerate(own):
            g = own[(k + 1) % len(own)]
            rows += [(t.replace("{f}", f"${f}").replace("{g}", f"${g}"), family, f) for t in texts if "{g}" not in t or g != f]
    return spark.createDataFrame(rows, "expression string, lane string, note string")


class Generator:
    """The arms over one set of atoms, one policy and one memory."""

    def __init__(self, spark: SparkSession, available: Iterable[str], policy: DataFrame, memory: DataFrame):
        self.spark, self.memory = spark, memory
        # A policy has some hundred rows, atoms likewise; worked out once, as every arm reads them many times.
        self.policy = spark.createDataFrame(policy.select("kind", "key", "score").collect(), "kind string, key string, score double")
        atoms = atom_table(spark, available)
        scored = policy_score(atoms.select(F.col("expr").alias("expression"), "lane", F.col("expr").alias("expression_hash")), self.policy)
        ranked = atoms.join(scored.select(F.col("expression_hash").alias("expr"), F.col("policy_score").alias("rank_score")), "expr")
        self.atoms = spark.createDataFrame(ranked.collect(), ranked.schema)

    def _pick(self, proposals: DataFrame, limit: int, lane_share: float, least_lane: int, fieldset_cap: int, arm: str, seen: DataFrame | None = None) -> list[dict]:
        scored = judged(proposals, self.policy, self.memory if seen is None else self.memory.unionByName(seen))
        # No lane can give more than its cap, so that many of each suffice, whatever the number of proposals.
        cap = max(least_lane, math.ceil(limit * lane_share))
        order = [F.desc("policy_score"), F.desc("expression_hash")]
        short = scored.withColumn("__nth", F.row_number().over(Window.partitionBy("lane", "fields").orderBy(*order))).where(F.col("__nth") <= fieldset_cap).drop("__nth")
        rows = [r.asDict() for r in short.orderBy(*order).collect()]
        return [r | {"generator_arm": arm} for r in pick_capped(rows, limit, {"lane": cap, "fields": fieldset_cap})]

    def _seen(self, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([(r["expression_hash"],) for r in rows], "expression_hash string")

    def broad(self, limit: int) -> list[dict]:
        """Ranked and inverted atoms, and products of the best event and state atoms."""
        made = single(self.atoms, RANKS, "rx").unionByName(crossed(self.atoms, PRODUCTS, "rx_interaction", max(32, limit)))
        return self._pick(made, limit, 0.10, 3, 4, "rx_ucb")

    def events(self, limit: int, seen: DataFrame | None = None) -> list[dict]:
        """A quarter typed events, a quarter guarded context, the rest products of events with states."""
        of = lambda role: self.atoms.where(F.col("role") == role)
        quota = min(limit, max(16, math.ceil(limit * 0.25)))
        pools = [
            (single(of("event_state_search"), {"event_rank": RANKS["rank"], "event_inverted": RANKS["inverted"]}, "typed_event_state"), quota),
            (single(of("lagged_context_search"), {"context_rank": RANKS["rank"], "context_inverted": RANKS["inverted"]}, "typed_lagged_context"), quota),
            (crossed(self.atoms.where((F.col("side") == "state") | (F.col("role") == "event_state_search")), {"event_x_state": PRODUCTS["product"], "event_minus_state": PRODUCTS["spread"]}, "typed_event_interaction", max(32, limit)), limit),
        ]
        taken: list[dict] = []
        for proposals, most in pools:
            known = self._seen(taken) if seen is None else seen.unionByName(self._seen(taken))
            taken += self._pick(proposals, min(most, limit - len(taken)), 0.35, 8, 4, "event_state", known) if len(taken) < limit else []
        return taken

    def slow(self, limit: int) -> list[dict]:
        """Smoothed and delayed atoms and products, which turn over less."""
        calm = self.atoms.where(F.col("role") != "event_state_search")
        made = single(calm, SLOW, "turnover_aware").unionByName(crossed(calm, SLOW_PRODUCTS, "turnover_aware_interaction", max(32, limit)))
        return [r | {"expected_turnover_bucket": "low"} for r in self._pick(made, limit, 0.14, 5, 6, "turnover_aware")]

    def elites(self, limit: int, rounds: int = 2, elite_share: float = 0.2, seen: DataFrame | None = None) -> list[dict]:
        """Cross-entropy rounds: the best proposals' fields decide which atoms the next round combines."""
        pool = single(self.atoms, RANKS, "cem_atom").unionByName(crossed(self.atoms, SIGNED, "cem_interaction", max(16, limit // 2)))
        atoms = self.atoms
        for _ in range(max(1, rounds)):
            ranked = judged(pool, self.policy, self.memory).orderBy(F.desc("policy_score"), F.desc("expression_hash")).limit(max(limit, 96))
            best = ranked.limit(max(4, math.ceil(max(limit, 96) * min(0.5, max(0.05, elite_share))))).select("fields").collect()
            credit = Counter(f for r in best for f in r["fields"].split("|"))
            credited = F.coalesce(F.create_map(*[F.lit(x) for kv in credit.items() for x in kv])[F.array_join("needs", "|")], F.lit(0)) if credit else F.lit(0)
            renewed = atoms.withColumn("rank_score", credited + F.col("rank_score") / 100)
            pool = pool.unionByName(crossed(renewed, RESAMPLED, "cem_resample", max(6, limit // 8)))
        return self._pick(pool, limit, 0.12, 4, 5, "cem_elite", seen)

    def hybrid(self, limit: int) -> list[dict]:
        """A quarter events and context if both are there, of the rest 45% broad, and elites."""
        roles = {r["role"] for r in self.atoms.select("role").distinct().collect()}
        side = math.ceil(limit * 0.25) if {"event_state_search", "lagged_context_search"} <= roles else 0
        rx = max(1, math.ceil((limit - side) * 0.45))
        taken = self.broad(rx)
        if side:
            taken = self.events(side, self._seen(taken)) + taken
        taken += self.elites(max(1, limit - len(taken)), seen=self._seen(taken))
        return [r | {"generator_arm": "hybrid"} for r in taken[:limit]]

    def arm(self, name: str, limit: int) -> list[dict]:
        return {"rx_ucb": self.broad, "event_state": self.events, "turnover_aware": self.slow, "cem_elite": self.elites, "hybrid": self.hybrid}[name](limit)


Evaluate = Callable[[list[dict]], tuple[DataFrame, DataFrame]]
Progress = Callable[[dict], None]


def tell(progress: Progress | None, **event) -> None:
    """Reports an event, if there is someone to report to; that may fail, the work goes on."""
    if progress is None:
        return
    try:
        progress(event)
    except Exception as failure:  # a callback is foreign code: no failure of it may change results
        logging.getLogger(__name__).warning("progress callback: %s", failure)


def adaptive_rounds(spark: SparkSession, available: list[str], policy: DataFrame, memory: DataFrame, evaluate: Evaluate, plan: list[str], limit: int, least: int = 8, progress: Progress | None = None) -> list[dict]:
    """Rounds of generating, measuring and learning: each round's decisions move the policy of the next.

    evaluate: candidates to (metrics by formula and horizon, correlations of formulas). One
    row a round: arm, candidates, follow-ups and the best correlation. ``progress`` is told of
    each round's start and end.
    """
    report = []
    for number, arm in enumerate(plan, 1):
        tell(progress, event="round_start", round=number, rounds=len(plan), arm=arm)
        rows = Generator(spark, available, policy, memory).arm(arm, limit)
        if not rows:
            report.append({"round": number, "arm": arm, "candidates": 0, "followups": 0, "best_abs_ic": None})
            tell(progress, event="round_end", **report[-1])
            continue
        decisions = decide(*evaluate(rows))
        texts = spark.createDataFrame([(r["expression_hash"], r["expression"], r["lane"]) for r in rows], "expression_hash string, expression string, lane string")
        learned = decisions.join(texts, "expression_hash")
        summary = decisions.agg(F.count_if(F.col("decision") == "bp_followup_priority").alias("f"), F.max("abs_aligned_ic_mean").alias("b")).first()
        report.append({"round": number, "arm": arm, "candidates": len(rows), "followups": summary["f"], "best_abs_ic": summary["b"]})
        tell(progress, event="round_end", **report[-1])
        moved = [(r["kind"], r["key"], r["score"]) for r in policy_feedback(policy, learned, least=least).collect()]
        policy = spark.createDataFrame(moved, "kind string, key string, score double")
        memory = memory.unionByName(texts.select("expression_hash"))
    if release := getattr(evaluate, "release", None):
        release()
    return report
