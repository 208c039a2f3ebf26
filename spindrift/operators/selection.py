"""Filters, picks and sets."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.numeric import steady_round as rnd
from spindrift.sources.panels import prepare_panel


def panel_filter(panel: DataFrame) -> DataFrame:
    return prepare_panel(panel, ["close"])


def evaluation_range(signals: DataFrame, start, end) -> DataFrame:
    """Rows of the dates asked for; to be applied to finished signals, as their windows need the rows before."""
    return signals.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def pick_ends(signals: DataFrame, share: float, by: list[str] | None = None, signal: str = "signal") -> DataFrame:
    """Rows with ``side`` top or bottom: the ceiling of the share of each section, one at least, by signal and then code."""
    by = by or ["date"]
    section = Window.partitionBy(*by)
    size = F.greatest(F.ceil(F.count("*").over(section) * share), F.lit(1))
    high = F.row_number().over(section.orderBy(F.desc(signal), "code"))
    low = F.row_number().over(section.orderBy(signal, "code"))
    ranked = signals.withColumns({"__size": size, "__high": high, "__low": low})
    sides = F.array_compact(F.array(F.when(F.col("__high") <= F.col("__size"), "top"), F.when(F.col("__low") <= F.col("__size"), "bottom")))
    return ranked.withColumn("side", F.explode(sides)).drop("__size", "__high", "__low")


def pick_quantiles(signals: DataFrame, share: float, signal: str = "signal") -> DataFrame:
    """Rows at or beyond the interpolated quantiles of their date."""
    section = Window.partitionBy("date")
    cuts = signals.withColumns({"__low": F.percentile(signal, F.lit(share)).over(section), "__high": F.percentile(signal, F.lit(1 - share)).over(section)})
    sides = F.array_compact(F.array(F.when(F.col(signal) >= F.col("__high"), "top"), F.when(F.col(signal) <= F.col("__low"), "bottom")))
    return cuts.withColumn("side", F.explode(sides)).drop("__low", "__high")


def first_of(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("__place", place).where("__place = 1").drop("__place")


def top_rows(table: DataFrame, scores: list[str], n: int, tie: str) -> DataFrame:
    """A report's first rows: by scores downwards, missing ones as -999, then by ``tie``."""
    return table.orderBy(*[F.coalesce(F.col(s), F.lit(-999.0)).desc() for s in scores], tie).limit(n)


def pick_capped(rows: Iterable[dict], limit: int, caps: dict[str, int]) -> list[dict]:
    """Rows in their order, skipping any that would take a key's value over its cap.

    Whether a row stays depends on all rows taken before it, so this is a walk over the
    proposals until enough are taken, not a window; they may come one by one.
    """
    taken: list[dict] = []
    counts: dict[tuple[str, object], int] = {}
    for row in rows:
        if len(taken) >= limit:
            break
        if all(counts.get((key, row[key]), 0) < cap for key, cap in caps.items()):
            taken.append(row)
            for key in caps:
                counts[key, row[key]] = counts.get((key, row[key]), 0) + 1
    return taken


def balanced_pick(candidates: DataFrame, arms: list[str], limit: int, order: list[Column]) -> DataFrame:
    """One of each arm in turn, arms in their fixed order, until the limit."""
    turn = F.row_number().over(Window.partitionBy("generator_arm").orderBy(*order))
    arm = F.array_position(F.array(*map(F.lit, arms)), F.col("generator_arm"))
    return candidates.where(F.col("generator_arm").isin(arms)).withColumns({"turn": turn, "__arm": arm}).orderBy("turn", "__arm").limit(limit).drop("__arm")


def breadth_first(candidates: DataFrame, limit: int) -> DataFrame:
    """The first candidate of each set of fields, then the others, each in order of position."""
    nth = F.row_number().over(Window.partitionBy("fields").orderBy("position"))
    return candidates.withColumn("__later", nth > 1).orderBy("__later", "position").limit(limit).drop("__later")


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, columns by name; what a part lacks is NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def mix_unique(primary: DataFrame, secondary: DataFrame, limit: int, key: str = "expression_hash") -> DataFrame:
    """Primary rows, then secondary ones, each key once, in order of position, up to a limit."""
    both = primary.withColumn("source_rank", F.lit(0)).unionByName(secondary.withColumn("source_rank", F.lit(1)))
    return first_of(both, [key], [F.col("source_rank"), F.col("position")]).orderBy("source_rank", "position").limit(limit)


def label_overlaps(labels: DataFrame) -> DataFrame:
    """For each two labels: items in both, in either, Jaccard, and the share of the first that is in the second.

    Pairs come from items that two labels share, not from all pairs of labels.
    """
    one = labels.select("label", "item").distinct()
    sizes = one.groupBy("label").agg(F.count("*").alias("n"))
    shared = (
        one.withColumnRenamed("label", "left_label").join(one.withColumnRenamed("label", "right_label"), "item").where("left_label < right_label").groupBy("left_label", "right_label").agg(F.count("*").alias("shared"))
    )
    out = shared.join(sizes.select(F.col("label").alias("left_label"), F.col("n").alias("left_n")), "left_label").join(sizes.select(F.col("label").alias("right_label"), F.col("n").alias("right_n")), "right_label")
    union = F.col("left_n") + F.col("right_n") - F.col("shared")
    return out.select("left_label", "right_label", "shared", union.alias("united"), rnd(F.col("shared") / union, 6).alias("jaccard"), rnd(F.col("shared") / F.col("left_n"), 6).alias("left_covered"))


def event_days(panel: DataFrame, weights: dict[str, float], count: int) -> DataFrame:
    """The dates of the highest weighted event score, and each one's date before."""
    scored = panel.groupBy("date").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in weights])
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    chosen = scored.select("date", score.alias("score")).orderBy(F.desc("score"), "date").limit(count).select("date")
    calendar = panel.select("date").distinct().withColumn("before", F.lag("date").over(Window.orderBy("date")))
    before = calendar.join(chosen, "date", "left_semi").select(F.col("before").alias("date")).where("date is not null")
    return chosen.union(before).distinct()


Order = Callable[[DataFrame], list[Column]]
