"""Mixing sources to target weights: budget fitting as a subset sum over length counts.

A source's target is met by whole repeats of all its documents and, for the rest of the
budget, a subset of them. The subset is found on counts of documents by exact length:
every length gives its proportional share, the longest lengths take most of what is
left, and bounded-knapsack dynamic programming fits the remainder as closely as any
choice can. Which documents of a length are taken follows from a seeded hash.

The programme's table holds ``DP_WORDS`` words, so a budget beyond that is fitted in two
steps: proportional shares and longest lengths down to that many words, then the
programme over the rest. That is the method's bound, and loses nothing while short
documents are left to fill the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import fresh_name, materialize, row_marks

#: Shares of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source, and no document, is taken more often than this.
MOST_REPEATS = 3.0
SEED = 17
#: Words left to the dynamic programme, besides one document of the longest length.
DP_WORDS = 1 << 16
#: Documents of one source and length that are ranked together, about; more are dealt to parts of the hash range.
RANK_ROWS = 4096
#: Equal rows that are written out in one go.
WRITTEN_ROWS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, times: int = 1, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take, each up to ``times`` times, so that the words come near ``budget``.

    lengths: distinct; a length of 0 gets none. Every length gives its proportional share
    first, and the programme fits the rest. Where few documents leave it far off, the
    programme fits the whole budget, if it is within ``dp_words``. Memory follows
    ``dp_words`` and the longest length, not the counts.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    usable = lengths > 0
    total = sum(int(a) * int(b) for a, b in zip(lengths[usable], counts[usable], strict=True))
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    share = np.array([int(c) * budget // total if n else 0 for n, c in zip(lengths, counts, strict=True)], np.int64)
    picks = _fit(lengths, counts * times, share, budget, dp_words)
    off = abs(budget - int((lengths * picks).sum()))
    if off and budget <= dp_words:
        whole = _fit(lengths, counts * times, np.zeros(len(lengths), np.int64), budget, dp_words)
        if abs(budget - int((lengths * whole).sum())) < off:
            return whole
    return picks


def _fit(lengths: np.ndarray, limits: np.ndarray, base: np.ndarray, budget: int, dp_words: int) -> np.ndarray:
    """``base`` and as many more documents, up to ``limits``, as come nearest to ``budget``; of two as near the lower sum."""
    picks = np.minimum(base, limits)
    rest = budget - int((lengths * picks).sum())
    order = np.argsort(-lengths, kind="stable")
    for k in order:
        if lengths[k] and rest > dp_words:
            more = min(int(limits[k] - picks[k]), (rest - dp_words) // int(lengths[k]))
            picks[k] += more
            rest -= more * int(lengths[k])
    if rest <= 0:
        return picks
    # A sum above the budget is nearer than 0 only below twice the rest.
    top = 2 * rest
    # via[s]: the lot by which the sum s was first reached; lots are 1, 2, 4, ... documents of one length.
    via = np.full(top + 1, -1, np.int32)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    lots: list[tuple[int, int]] = []
    for k in order[::-1]:
        length, left, lot = int(lengths[k]), int(limits[k] - picks[k]), 1
        if not length or length > top:
            continue
        left = min(left, top // length)
        while left and not reached[rest]:
            take = min(lot, left)
            step = take * length
            if step <= top:
                new = reached[: top + 1 - step] & ~reached[step:]
                via[step:][new] = len(lots)
                reached[step:] |= new
                lots.append((k, take))
            left -= take
            lot *= 2
        if reached[rest]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - rest).argmin()])
    while at:
        k, take = lots[via[at]]
        picks[k] += take
        at -= take * int(lengths[k])
    return picks


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    picks = fit_budget(group["size"].to_numpy(), group["n"].to_numpy(), int(group["budget"].iloc[0]), int(group["times"].iloc[0]))
    return pd.DataFrame({"source_no": group["source_no"], "size": group["size"], "picks": picks})


def source_targets(histogram: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """Rows (source, source_no, source_size, target) from rows (source, size, n).

    Sources in code point order, null last, weigh as ``weights`` repeat. A target is the
    lower of ``most`` times the source's size and the weight times one common level,
    where the level makes the targets sum to all sizes: resharing what is above the
    limit by weight, until nothing is, ends there.
    """
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("source_no", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    )
    limited = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("limit") / F.col("weight"))
    by_level = Window.orderBy("level", "source_no")
    everything = Window.partitionBy()
    opened = limited.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn(
        "common",
        (F.col("total") - F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
    )
    # Sources below the first that its own level suits stay at their limits.
    first = F.min(F.when(F.col("common") <= F.col("level"), F.struct("level", "source_no", "common"))).over(everything)
    return opened.withColumn("settled", first["common"]).select(
        "source", "source_no", "source_size", F.least("limit", F.col("settled") * F.col("weight")).alias("target")
    )


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """Rows (id, source, size, mark, check), where the last two are hashes of the whole row."""
    words = F.coalesce(F.regexp_count(F.col(f"`{text_column}`"), F.lit(WORD)), F.lit(0)).cast("long")
    mark, check = row_marks(docs)
    return docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").alias("source"), words.alias("size"), mark.alias("mark"), check.alias("check"))


def _taken(sized: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """``sized`` with source_size, target and copies: how often the mix takes the document."""
    histogram = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    targets = materialize(source_targets(histogram, weights, most), "mix-targets")
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("repeats", repeats.cast("long")).withColumn("budget", F.floor(F.col("target")).cast("long") - F.col("repeats") * F.col("source_size"))
    same_source = F.col("source").eqNullSafe(F.col("of_source"))
    lengths = histogram.join(targets.withColumnRenamed("source", "of_source"), same_source).drop("of_source").withColumn("times", F.lit(int(most)) - F.col("repeats"))
    picks = lengths.select("source_no", "size", "n", "budget", "times").groupBy("source_no").applyInPandas(_plan, "source_no int, size bigint, picks bigint")
    parts = F.ceil(F.col("n") / RANK_ROWS).cast("long").alias("parts")
    plan = materialize(lengths.join(picks, ["source_no", "size"]).select(F.col("source").alias("of_source"), F.col("size").alias("of_size"), "source_no", "n", parts, "picks", "repeats", "source_size", "target"), "mix-plan")
    # Documents of one source and length are ranked by hash. Of many, parts of the hash range are counted first, so no task ranks a whole crowd.
    order = F.xxhash64(F.lit(seed), "id")
    dealt = sized.join(plan, same_source & (F.col("size") == F.col("of_size"))).withColumn("rank_key", order).withColumn("part", F.pmod("rank_key", "parts"))
    keys = ["source_no", "size", "part"]
    counts = dealt.where("parts > 1").groupBy(*keys).agg(F.count("*").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy("source_no", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, before.alias("before"))
    rank = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys).orderBy("rank_key", "id", "mark", "check"))
    extra = F.floor(F.col("picks") / F.col("n")) + (rank <= F.col("picks") % F.col("n")).cast("long")
    return dealt.join(counts, keys, "left").withColumn("copies", F.col("repeats") + extra)


def mix_plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, taken (words, repeats counted).

    A null text has size 0, and a document of size 0 is never taken beyond its 0 words.
    A null source is a source of its own, the last. Repeated rows count each; which of
    several equal rows is taken can't be told apart. An empty table gives an empty one.
    Windows over sources and over parts of a length have a row for each of these only.
    """
    sized = materialize(_sized(docs, id_column, text_column, source_column), "mix-sizes")
    return _taken(sized, weights, most, seed).select(
        F.col("id").alias(id_column), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """The documents that the mix takes, with ``copies``: how often. All columns of ``docs`` stay.

    A column of ``docs`` called ``copies`` keeps its name; the count then gets a leading
    underscore. Documents without words (null, empty) are never taken; a null source is
    a source of its own; of equal rows some may be taken once more than others; an empty
    table gives an empty one. Copies are decided on narrow rows. Equal rows meet as
    partial results, by hashes of the whole row, and are written out again afterwards,
    so no crowd of them goes through one task.
    """
    columns = docs.columns
    mark, check, copies, low, every, n, nth = (fresh_name(docs, x) for x in ("mix_mark", "mix_check", "copies", "mix_low", "mix_all", "mix_n", "mix_nth"))
    sized = materialize(_sized(docs, id_column, text_column, source_column), "mix-sizes")
    # Copies of equal rows differ by one at most, so three numbers tell how often to take how many.
    plan = _taken(sized, weights, most, seed).groupBy(F.col("mark").alias(mark), F.col("check").alias(check)).agg(F.min("copies").alias(low), F.sum("copies").alias(every), F.count("*").alias(n))
    plan = materialize(plan.where(F.col(every) > 0), "mix-rows")
    once = docs.withColumns(dict(zip((mark, check), row_marks(docs), strict=True))).dropDuplicates([mark, check])

    def written(rows: DataFrame, first, last) -> DataFrame:
        """Each of ``rows`` from its ``first`` to its ``last`` time."""
        return rows.withColumn(nth, F.explode(F.sequence(first, last)))

    few = plan.where(F.col(n) <= WRITTEN_ROWS)
    taken = written(once.join(few, [mark, check]), F.lit(1).cast("long"), F.col(n))
    many = plan.where(F.col(n) > WRITTEN_ROWS)
    if not many.isEmpty():
        lot = fresh_name(docs, "mix_lot")
        lots = once.join(many, [mark, check]).withColumn(lot, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / WRITTEN_ROWS))))
        lots = lots.repartition(mark, check, lot)
        taken = taken.unionByName(written(lots, F.col(lot) * WRITTEN_ROWS + 1, F.least(F.col(n), (F.col(lot) + 1) * WRITTEN_ROWS)).drop(lot))
    taken = taken.withColumn(copies, F.col(low) + (F.col(nth) <= F.col(every) - F.col(n) * F.col(low)).cast("long"))
    return taken.where(F.col(copies) > 0).select(*[F.col(f"`{c}`") for c in columns], copies)
