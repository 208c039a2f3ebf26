"""Formulas to staged window plans.

Window functions can't be nested in one expression, so every windowed step becomes a
column before a later step reads it. Steps are shared between all formulas compiled
together and come in phases: all that can run over the series of a code, then all that
can run over cross-sections, and so on in turn. A phase costs one exchange, however many
steps it holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.numeric import as_number, divide, finite
from spindrift.plans.expr import Call, Field, Node, Number, UnsupportedExpression, parse
from spindrift.sources.panels import Keys

SERIES, SECTION, PLAIN = "series", "section", "plain"
Builder = Callable[..., Column]


@dataclass(frozen=True)
class Step:
    """One column: where it can run, what it reads, and how it is made of that."""

    name: str
    kind: str
    reads: tuple[str, ...]
    build: Builder


class Compiler:
    def __init__(self, keys: Keys, columns: list[str], lags: dict[str, int] | None = None):
        self.keys, self.columns, self.lags = keys, set(columns), lags or {}
        self.steps: dict[tuple, Step] = {}
        self.order: list[Step] = []
        self.series = Window.partitionBy(keys.code).orderBy(keys.time)
        self.section = Window.partitionBy(keys.section)

    # --- making steps

    def step(self, key: tuple, kind: str, reads: tuple[str, ...], build: Builder) -> str:
        """The column of a step; equal keys give the same one."""
        if key not in self.steps:
            made = Step(f"__f{len(self.steps)}", kind, reads, build)
            self.steps[key] = made
            self.order.append(made)
        return self.steps[key].name

    def frame(self, window: int):
        return self.series.rowsBetween(-(window - 1), 0)

    def compile(self, node: Node) -> str:
        if isinstance(node, Field):
            return self.field(node.name, self.lags.get(node.name, 0))
        if isinstance(node, Number):
            return self.step(("number", node.value), PLAIN, (), lambda v=node.value: F.lit(v))
        return getattr(self, f"op_{node.name.lower()}")(node)

    def field(self, name: str, lag: int) -> str:
        if name not in self.columns:
            raise UnsupportedExpression(f"missing_field:{name}")
        plain = self.step(("field", name), PLAIN, (), lambda: as_number(F.col(f"`{name}`")))
        return self.lagged(plain, lag) if lag > 0 else plain

    def lagged(self, of: str, by: int) -> str:
        return self.step(("lag", of, by), SERIES, (of,), lambda c: F.lag(c, by).over(self.series))

    def plain(self, key: tuple, build: Builder, *reads: str) -> str:
        return self.step((*key, *reads), PLAIN, reads, build)

    def rolling(self, key: str, of: str, window: int, aggregate: Callable[[Column], Column], least: int | None = None) -> str:
        """An aggregate over the last rows of a series, NULL with fewer values than ``least`` (all, if not given)."""
        frame = self.frame(window)
        needed = window if least is None else least
        return self.step((key, of, window, needed), SERIES, (of,), lambda c: F.when(F.count(c).over(frame) >= needed, aggregate(c).over(frame)))

    # --- elementwise

    def _args(self, node: Call) -> list[str]:
        return [self.compile(a) for a in node.args]

    def op_add(self, node: Call) -> str:
        return self.plain(("add",), lambda a, b: finite(a + b), *self._args(node))

    def op_sub(self, node: Call) -> str:
        return self.plain(("sub",), lambda a, b: finite(a - b), *self._args(node))

    def op_mul(self, node: Call) -> str:
        return self.plain(("mul",), lambda a, b: finite(a * b), *self._args(node))

    def op_div(self, node: Call) -> str:
        return self.plain(("div",), lambda a, b: finite(divide(a, b)), *self._args(node))

    def op_abs(self, node: Call) -> str:
        return self.plain(("abs",), F.abs, *self._args(node))

    def op_sign(self, node: Call) -> str:
        return self.plain(("sign",), F.signum, *self._args(node))

    def op_log(self, node: Call) -> str:
        return self.plain(("log",), lambda a: F.log(F.abs(F.nullif(a, F.lit(0.0)))), *self._args(node))

    def op_neg(self, node: Call) -> str:
        return self.plain(("neg",), lambda a: -a, *self._args(node))

    # --- cross-sections

    def op_csrank(self, node: Call) -> str:
        return self.section_rank(self.compile(node.args[0]))

    def section_rank(self, of: str) -> str:
        """Average rank of a value among the values of its cross-section, divided by their number."""
        ordered = self.section.orderBy(F.col(of).asc_nulls_last())
        ties = ordered.rangeBetween(Window.currentRow, Window.currentRow)  # rows of the same value; the rank's own order serves

        def build(c: Column) -> Column:
            average = F.rank().over(ordered) + (F.count(c).over(ties) - 1) / F.lit(2.0)
            return F.when(c.isNotNull(), average / F.count(c).over(self.section))

        return self.step(("csrank", of), SECTION, (of,), build)

    def op_zscore(self, node: Call) -> str:
        return self.section_score(self.compile(node.args[0]))

    def section_score(self, of: str) -> str:
        def build(c: Column) -> Column:
            spread = F.stddev_samp(c).over(self.section)
            return F.when((F.count(c).over(self.section) >= 2) & (spread > 0), divide(c - F.avg(c).over(self.section), spread))

        return self.step(("zscore", of), SECTION, (of,), build)

    def op_csresidual(self, node: Call) -> str:
        return self.residual(*self._args(node), least=5, distinct=0, ratio=0.0)

    def op_safecsresidual(self, node: Call) -> str:
        y, x = (self.compile(a) for a in node.args[:2])
        least, distinct, ratio = (a.value for a in node.args[2:])
        return self.residual(y, x, least=max(2, int(least)), distinct=max(2, int(distinct)), ratio=ratio)

    def residual(self, y: str, x: str, least: int, distinct: int, ratio: float) -> str:
        """What a straight line of x leaves of y, within a cross-section's rows that have both."""

        def build(a: Column, b: Column) -> Column:
            both = a.isNotNull() & b.isNotNull()
            u, v = F.when(both, a), F.when(both, b)
            spread = F.var_pop(v).over(self.section)
            slope = divide(F.covar_pop(u, v).over(self.section), spread)
            enough = (F.count(u).over(self.section) >= least) & (spread > 0)
            if distinct:
                enough &= F.size(F.collect_set(v).over(self.section)) >= distinct
                enough &= F.count(u).over(self.section) >= ratio * F.count(F.lit(1)).over(self.section)
            start = F.avg(u).over(self.section) - slope * F.avg(v).over(self.section)
            return F.when(both & enough, u - (start + slope * v))

        return self.step(("residual", y, x, least, distinct, ratio), SECTION, (y, x), build)

    # --- series

    def _windowed(self, node: Call) -> tuple[str, int]:
        return self.compile(node.args[0]), int(node.args[1].value)

    def op_mean(self, node: Call) -> str:
        return self.rolling("mean", *self._windowed(node), F.avg)

    def op_std(self, node: Call) -> str:
        return self.rolling("std", *self._windowed(node), F.stddev_samp)

    def op_med(self, node: Call) -> str:
        return self.rolling("med", *self._windowed(node), lambda c: F.percentile(c, F.lit(0.5)))

    def op_skew(self, node: Call) -> str:
        of, n = self._windowed(node)
        if n < 3:
            return self.plain(("void",), lambda c: F.lit(None).cast("double"), of)
        raw = self.rolling("skewness", of, n, F.skewness)
        return self.plain(("skew", n), lambda c: c * math.sqrt(n * (n - 1)) / (n - 2), raw)

    def op_kurt(self, node: Call) -> str:
        of, n = self._windowed(node)
        if n < 4:
            return self.plain(("void",), lambda c: F.lit(None).cast("double"), of)
        raw = self.rolling("kurtosis", of, n, F.kurtosis)
        return self.plain(("kurt", n), lambda c: (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * c + 6), raw)

    def op_delay(self, node: Call) -> str:
        n = int(node.args[1].value)
        if isinstance(node.args[0], Field):  # the longer of the delay and the clock's own lag, not both
            name = node.args[0].name
            return self.field(name, max(n, self.lags.get(name, 0)))
        return self.lagged(self.compile(node.args[0]), n)

    def op_delta(self, node: Call) -> str:
        of, n = self._windowed(node)
        return self.plain(("delta",), lambda a, b: a - b, of, self.lagged(of, n))

    def op_mom(self, node: Call) -> str:
        of, n = self._windowed(node)
        return self.plain(("mom",), lambda a, b: finite(divide(a, b)) - 1, of, self.lagged(of, n))

    def op_wma(self, node: Call) -> str:
        of, n = self._windowed(node)
        total = n * (n + 1) / 2

        def build(c: Column) -> Column:
            values = F.collect_list(c).over(self.frame(n))  # skips NULLs, so a full list has no gap
            weighted = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
            return F.when(F.size(values) == n, weighted / total)

        return self.step(("wma", of, n), SERIES, (of,), build)

    def relation(self, kind: str, x: str, y: str, window: int, least: int) -> str:
        frame = self.frame(window)

        def build(a: Column, b: Column) -> Column:
            both = a.isNotNull() & b.isNotNull()
            u, v = F.when(both, a), F.when(both, b)
            shared = F.covar_samp(u, v).over(frame)
            value = shared if kind == "cov" else divide(shared, F.stddev_samp(u).over(frame) * F.stddev_samp(v).over(frame))
            return F.when(F.count(u).over(frame) >= max(least, 2), finite(value))

        return self.step((kind, x, y, window, least), SERIES, (x, y), build)

    def op_corr(self, node: Call) -> str:
        window = int(node.args[2].value)
        return self.relation("corr", self.compile(node.args[0]), self.compile(node.args[1]), window, min(5, window))

    def op_cov(self, node: Call) -> str:
        window = int(node.args[2].value)
        return self.relation("cov", self.compile(node.args[0]), self.compile(node.args[1]), window, min(5, window))

    # --- events, states, coverage

    def op_eventage(self, node: Call) -> str:
        of = self.compile(node.args[0])
        place = self.step(("place",), SERIES, (), lambda: F.row_number().over(self.series))
        last = self.step(("last event", of), SERIES, (of, place), lambda c, p: F.last(F.when(c != 0, p), True).over(self.series.rowsBetween(Window.unboundedPreceding, 0)))
        return self.plain(("event age",), lambda p, e: (p - e).cast("double"), place, last)

    def op_eventcount(self, node: Call) -> str:
        of, n = self._windowed(node)
        event = self.plain(("is event",), lambda c: F.when(c.isNotNull(), F.when(c != 0, 1.0).otherwise(0.0)), of)
        return self.rolling("sum", event, n, F.sum)

    op_windowstatecount = op_eventcount

    def op_stateage(self, node: Call) -> str:
        return self.run_length(self.compile(node.args[0]))

    def op_statedwell(self, node: Call) -> str:
        of, n = self._windowed(node)
        run = self.run_length(of)
        return self.plain(("capped", n), lambda c: F.when(c > n, float(n)).otherwise(c), run) if n > 0 else run

    def run_length(self, of: str) -> str:
        """Rows since the value last changed, this one included; NULL ends a run and is in none."""
        place = self.step(("place",), SERIES, (), lambda: F.row_number().over(self.series))
        before = self.lagged(of, 1)
        starts = self.plain(("run starts",), lambda c, b, p: F.when(b.isNull() | c.isNull() | (c != b), p), of, before, place)
        start = self.step(("run start", starts), SERIES, (starts,), lambda s: F.last(s, True).over(self.series.rowsBetween(Window.unboundedPreceding, 0)))
        return self.plain(("run length",), lambda c, p, s: F.when(c.isNotNull(), (p - s + 1).cast("double")), of, place, start)

    def op_validratiogate(self, node: Call) -> str:
        return self.gated(self.compile(node.args[0]), int(node.args[1].value), node.args[2].value)

    def gated(self, of: str, window: int, ratio: float) -> str:
        frame = self.frame(window)
        share = self.step(("valid share", of, window), SERIES, (of,), lambda c: F.avg(F.when(c.isNotNull(), 1.0).otherwise(0.0)).over(frame))
        return self.plain(("gate", ratio), lambda c, s: F.when(s >= ratio, c), of, share)

    def op_maskedzscore(self, node: Call) -> str:
        return self.section_score(self.op_validratiogate(node))

    def op_maskedcorr(self, node: Call) -> str:
        x, y = (self.compile(a) for a in node.args[:2])
        window, ratio = int(node.args[2].value), node.args[3].value
        corr = self.relation("corr", x, y, window, max(2, math.ceil(ratio * window)))
        frame = self.frame(window)
        both = self.plain(("both",), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), 1.0).otherwise(0.0), x, y)
        share = self.step(("share", both, window), SERIES, (both,), lambda c: F.avg(c).over(frame))
        return self.plain(("gate", ratio), lambda c, s: F.when(s >= ratio, c), corr, share)

    # --- running

    def run(self, panel: DataFrame) -> DataFrame:
        """``panel`` with the columns of all steps, phase by phase."""
        done: set[str] = set()
        waiting = list(self.order)
        out = panel
        turn = SERIES
        while waiting:
            batch = self._ready(waiting, done, PLAIN) or self._ready(waiting, done, turn)
            if not batch:
                turn = SECTION if turn == SERIES else SERIES
                continue
            out = out.withColumns({s.name: s.build(*(F.col(r) for r in s.reads)) for s in batch})
            done |= {s.name for s in batch}
            waiting = [s for s in waiting if s.name not in done]
        return out

    @staticmethod
    def _ready(waiting: list[Step], done: set[str], kind: str) -> list[Step]:
        return [s for s in waiting if s.kind == kind and done.issuperset(s.reads)]


def evaluate(panel: DataFrame, formulas: dict[str, str], lags: dict[str, int] | None = None, keys: Keys | None = None) -> DataFrame:
    """``panel`` with a column for each named formula.

    lags: rows by which a field is late for the signal's clock; applied where the field is read.
    """
    compiler = Compiler(keys or Keys.of(panel), panel.columns, lags)
    made = {name: compiler.compile(parse(text)) for name, text in formulas.items()}
    out = compiler.run(panel)
    return out.select(*[F.col(f"`{c}`") for c in panel.columns if c not in made], *[F.col(c).alias(name) for name, c in made.items()])
