"""Joins that show a row only what was known before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.panels import minute_of_day


def latest(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in order."""
    rest = [c for c in table.columns if c not in keys]
    if not rest:
        return table.dropDuplicates(keys)
    picked = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return picked.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the last right row of the key strictly before its time; NULL if there is none.

    Both sides go through one sort by key and time, so no pair of rows is ever formed. The
    search runs over the distinct keys and times of ``left`` only; rows of the same day
    share its result. Of right rows of one key and time the last in order of values counts.
    """
    keys = left.select(*by, F.col(left_time).alias("__time")).where("__time is not null").distinct()
    facts = latest(right.select(*by, F.col(right_time).alias("__time"), *values).where("__time is not null"), [*by, "__time"], values)
    asked = keys.select("*", F.lit(0).alias("__fact"), F.lit(None).cast(facts.select(F.struct(*values)).schema[0].dataType).alias("__value"))
    given = facts.select(*by, "__time", F.lit(1).alias("__fact"), F.struct(*values).alias("__value"))
    # A fact of the very time sorts after the question, so it isn't seen by it.
    before = Window.partitionBy(*by).orderBy("__time", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    answered = asked.unionByName(given).withColumn("__seen", F.last("__value", True).over(before)).where("__fact = 0")
    found = answered.select(*by, F.col("__time").alias(left_time), *[F.col(f"__seen.{v}").alias(v) for v in values])
    return left.join(found, [*by, left_time], "left").select(*left.columns, *values)


def asof_market(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """As :func:`asof`, without a key: one value a date for all rows.

    The distinct times of ``left`` are far fewer than its rows; they and the market's
    table go through one sort, and rows then join by equal time.
    """
    one = F.lit(1).alias("__market")
    times = left.select(F.col(left_time), one).where(F.col(left_time).isNotNull()).distinct()
    found = asof(times, right.select("*", one), ["__market"], left_time, right_time, values).drop("__market")
    return left.join(found, left_time, "left").select(*left.columns, *values)


def event_cutoff_join(minutes: DataFrame, events: DataFrame, values: list[str]) -> DataFrame:
    """Same-day events, shown from their cutoff minute on: active flag, minutes since, and the values."""
    joined = minutes.join(events.withColumnRenamed("source_date", "date"), ["code", "date"], "left")
    minute = minute_of_day("trade_time")
    active = F.coalesce(minute >= F.col("cutoff_minute"), F.lit(False))
    return joined.select(
        *minutes.columns,
        active.cast("double").alias("event_active"),
        F.when(active, (minute - F.col("cutoff_minute")).cast("double")).alias("event_age_min"),
        *[F.when(active, F.col(v)).alias(v) for v in values],
    )


def hhmm_cutoff(table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns named ``..._by_HHMM`` or ``..._at_HHMM`` are empty before that time of day."""
    import re

    out = {}
    for c in columns:
        found = re.search(r"_(?:by|at)_(\d{4})$", c)
        if found:
            out[c] = F.when(F.date_format("trade_time", "HHmm") >= found[1], F.col(c))
    return table.withColumns(out)


def previous_calendar_join(left: DataFrame, daily: DataFrame, values: list[str]) -> DataFrame:
    """A day's values on the code's next day in ``daily``, and only there."""
    order = Window.partitionBy("code").orderBy("source_date")
    shown = daily.select("code", F.lead("source_date").over(order).alias("date"), *values).where("date is not null")
    return left.join(latest(shown, ["code", "date"], values), ["code", "date"], "left").select(*left.columns, *values)


def available_date(statements: DataFrame) -> Column:
    """When a statement was out: its notice date; if no row has one, its update date; if none has that, 90 days after the report date."""
    row = statements.agg(F.count("notice_date").alias("n"), F.count("update_date").alias("u")).first()
    if row["n"]:
        return F.col("notice_date")
    return F.col("update_date") if row["u"] else F.date_add("report_date", 90)


def asof_statements(left: DataFrame, statements: DataFrame, values: list[str]) -> DataFrame:
    dated = statements.withColumn("available_date", available_date(statements))
    return asof(left, dated, ["code"], "date", "available_date", values)


def exact_join(left: DataFrame, context: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Equal keys; of several rows the last in order."""
    return left.join(latest(context, on, order), on, "left")


def join_keeping_rows(left: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """A left join that can't multiply rows; raises if it did."""
    out = exact_join(left, right, on, order)
    before, after = left.count(), out.count()
    if before != after:
        raise ValueError(f"join changed the number of rows: {before} to {after}")
    return out


def outer_merge(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """All keys of all tables; of columns with one name the first table's stays."""
    out = tables[0]
    for t in tables[1:]:
        new = [c for c in t.columns if c in on or c not in out.columns]
        out = out.join(t.select(new), on, "full")
    return out


def fold_sidecars(base: DataFrame, sidecars: list[DataFrame], on: Callable[[DataFrame], list[str]]) -> DataFrame:
    """One left join after the other; each adds only columns that aren't there yet."""
    out = base
    for side in sidecars:
        keys = on(side)
        new = [c for c in side.columns if c not in out.columns]
        out = out.join(side.select(*keys, *new).dropDuplicates(keys), keys, "left")
    return out


def unseen(candidates: DataFrame, *memories: DataFrame, key: str = "expression_hash") -> DataFrame:
    """Candidates whose key no memory holds."""
    for memory in memories:
        candidates = candidates.join(memory.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return candidates


def lineage_check(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Results against inputs of the same hash: found, and of the same arm and id."""
    given = inputs.select("expression_hash", F.col("generator_arm").alias("input_arm"), F.col("candidate_id").alias("input_id"), F.lit(True).alias("found"))
    joined = results.join(given, "expression_hash", "left")
    status = (
        F.when(F.col("found").isNull(), "missing_input")
        .when(~F.col("generator_arm").eqNullSafe(F.col("input_arm")), "arm_mismatch")
        .when(~F.col("candidate_id").eqNullSafe(F.col("input_id")), "id_mismatch")
        .otherwise("consistent")
    )
    return joined.select("expression_hash", "candidate_id", "generator_arm", status.alias("lineage_status"))
