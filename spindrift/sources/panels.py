"""Panels: tables of one row per code and time. Readers, and adapters from general tables."""

from __future__ import annotations

from collections.abc import Iterable

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.numeric import as_number

REQUIRED_DAILY = ("date", "open", "high", "low", "close", "amount", "volume", "code")
REQUIRED_MINUTE = ("code", "trade_time", "date", "close")
#: Fixed: prefixes of codes that stand for indexes, not instruments.
INDEX_CODES = r"(?i)^(880|sh000|sz399|bj899)"


@dataclass(frozen=True)
class Keys:
    """Columns that place a row: its series, its time, and the cross-section it belongs to."""

    code: str = "code"
    time: str = "date"
    section: str = "date"

    @staticmethod
    def of(panel: DataFrame) -> Keys:
        time = "trade_time" if "trade_time" in panel.columns else "date"
        return Keys(time=time, section=time)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_panel(spark: SparkSession, path: str, columns: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """Parquet or CSV, by the path's ending; only the columns that are asked for and there."""
    if path.rstrip("/").endswith(".csv"):
        panel = spark.read.csv(path, header=True)
    else:
        panel = spark.read.parquet(path)
    if columns is not None:
        panel = panel.select([c for c in columns if c in panel.columns])
    return panel if max_rows is None else panel.limit(max_rows)


def panel_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the footer or the header line alone."""
    return read_panel(spark, path).columns


def read_existing(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """The columns that are there; an empty table if the path or all of them are missing."""
    try:
        found = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return spark.createDataFrame([], schema)
    present = [c for c in columns if c in found.columns]
    return found.select(present) if present else spark.createDataFrame([], schema)


def read_years(spark: SparkSession, root: str, years: Iterable[int], schema: str) -> DataFrame:
    """Rows of a context kept in folders ``year=...``, of the years asked for that are there; none there: an empty table.

    Only the folders of those years are listed and read; the year itself is no column unless the files hold it.
    """
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    paths = [f"{root.rstrip('/')}/year={year}" for year in sorted(set(years))]
    there = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    return spark.read.schema(schema).option("basePath", root).parquet(*there).select(*[c.split()[0] for c in schema.split(", ")]) if there else spark.createDataFrame([], schema)


def read_shards(spark: SparkSession, pattern: str, limit: int | None = None) -> DataFrame:
    """All shards that match, with ``shard_index``: the number in the first ``shard_NN`` of the file's path."""
    panel = spark.read.parquet(pattern)
    shard = F.regexp_extract(F.input_file_name(), r"shard_(\d+)", 1)
    panel = panel.withColumn("shard_index", F.when(shard != "", shard).cast("int"))
    return panel if limit is None else panel.where(F.col("shard_index") < limit)


def data_contract(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED_DAILY) -> dict:
    """Whether a panel exists, which columns it has and lacks, and whether work can start."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    try:
        columns = panel_columns(spark, path)
    except Exception as missing:
        return {"exists": False, "columns": [], "missing": list(required), "can_start": False, "role": dataset_role(name), "error": type(missing).__name__}
    lacking = [c for c in required if c not in columns]
    return {"exists": True, "columns": columns, "missing": lacking, "can_start": not lacking, "role": dataset_role(name)}


def dataset_role(name: str) -> str:
    """What a panel file is for, by its name."""
    name = name.lower()
    if "sector" in name:
        return "legacy_sector_panel"
    if "stock" in name or "pit" in name:
        return "stock_pit_panel"
    return "unknown_panel"


def prepare_panel(panel: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """Rows that can be used: keys and close there, instruments only; numbers finite or NULL."""
    keys = Keys.of(panel)
    out = panel.where(F.col(keys.time).isNotNull() & F.col("code").isNotNull() & F.col("close").isNotNull())
    if "instrument_type" in out.columns:
        out = out.where(F.col("instrument_type") == "stock")
    out = out.where(~F.col("code").rlike(INDEX_CODES))
    given = numeric if numeric is not None else [c for c in ("open", "high", "low", "close", "amount", "volume") if c in out.columns]
    return out.withColumns({c: as_number(F.col(c)) for c in given}).where(F.col("close").isNotNull())


def latest_date(panel: DataFrame) -> DataFrame:
    return panel.agg(F.max("date").alias("latest_date"))


def recent_rows(panel: DataFrame, lookback_days: int = 92, warmup_days: int = 90) -> DataFrame:
    """Rows from lookback and warm-up before the latest date on, with ``evaluation_start``.

    The latest date is found first and put into the filter as a literal, so the scan can skip by it.
    """
    latest = panel.agg(F.max("date")).first()[0]
    if latest is None:
        return panel.withColumn("evaluation_start", F.lit(None).cast("date")).limit(0)
    start = F.date_sub(F.lit(latest).cast("date"), lookback_days)
    return panel.where(F.col("date") >= F.date_sub(start, warmup_days)).withColumn("evaluation_start", start)


def recent_quarters(panel: DataFrame, quarters: int = 4, warmup_days: int = 90) -> DataFrame:
    """Rows of the last quarters and the warm-up before them, with ``evaluation_start``."""
    latest = panel.agg(F.max("date")).first()[0]
    if latest is None:
        return panel.withColumn("evaluation_start", F.lit(None).cast("date")).limit(0)
    start = F.add_months(F.trunc(F.lit(latest).cast("date"), "quarter"), -3 * (quarters - 1))
    return panel.where(F.col("date") >= F.date_sub(start, warmup_days)).withColumn("evaluation_start", start)


def panel_profile(panel: DataFrame, columns: list[str]) -> DataFrame:
    """One row: size, codes, first and last date, and missing values of each column, in one pass."""
    return panel.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("code").alias("code_count"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
    )


def distinct_times(panel: DataFrame) -> DataFrame:
    return panel.select("trade_time").where(F.col("trade_time").isNotNull()).distinct()


def sampled_times(panel: DataFrame, count: int) -> DataFrame:
    """Distinct times at evenly spaced places, ends included; all if there are no more than ``count``.

    The number of distinct times is small beside the panel; placing them needs one ordered pass over them.
    """
    times = distinct_times(panel)
    placed = times.withColumn("place", F.row_number().over(Window.orderBy("trade_time")) - 1)
    total = times.count()
    if count <= 0 or total <= count:
        return placed.select("trade_time", "place")
    step = (total - 1) / (count - 1) if count > 1 else 0.0
    places = times.sparkSession.range(count).select(F.bround(F.col("id") * F.lit(step)).cast("int").alias("place")).distinct()
    return placed.join(places, "place", "left_semi").select("trade_time", "place")


def time_windows(panel: DataFrame, sampled: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Rows of times within ``lookback`` places before to ``horizon`` after a sampled time."""
    placed = distinct_times(panel).withColumn("place", F.row_number().over(Window.orderBy("trade_time")) - 1)
    wanted = sampled.select(F.explode(F.sequence(F.col("place") - lookback, F.col("place") + horizon)).alias("place")).distinct()
    return panel.join(placed.join(wanted, "place", "left_semi").select("trade_time"), "trade_time", "left_semi")


def best_status(events: DataFrame, kind: int = 15) -> DataFrame:
    """Of the status events of one kind, the largest in size for each symbol and date; of equal sizes the higher."""
    order = F.struct(F.abs("status"), F.col("status"))
    return events.where(F.col("type") == kind).groupBy("symbol", "date").agg(F.max_by("status", order).alias("status"))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily-style panel from order lines: a code for each supplier, a date for each month."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "MM").alias("date")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
    )
    code = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0"))
    gap = (F.col("l_suppkey") + F.month("date")) % 7 == 0
    return grouped.select(
        code.alias("code"),
        "date",
        "open",
        "high",
        "low",
        "close",
        "volume",
        "amount",
        F.col("l_suppkey").alias("code_no"),
        F.when(~gap, F.col("amount")).alias("gappy"),
        F.when(~gap, F.floor(F.col("volume") / 40) % 3).cast("double").alias("level"),
    )


def minute_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minute-style panel from events: a code for each of ten user groups, a time for each hour."""
    events = table(spark, sf_dir, "events").withColumn("code_no", F.col("user_id") % 10).withColumn("trade_time", F.date_trunc("hour", "ts"))
    order = F.struct("ts", "event_id")
    grouped = events.groupBy("code_no", "trade_time").agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.avg("value").alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.sum("value").alias("amount"),
        F.max(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("event_flag"),
        F.count_if(F.col("event_type") == "error").cast("double").alias("error_count"),
    )
    return grouped.select(
        F.concat(F.lit("U"), F.col("code_no").cast("string")).alias("code"),
        "trade_time",
        F.col("trade_time").cast("date").alias("date"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "amount",
        "event_flag",
        "error_count",
        "code_no",
        (F.col("code_no") % 2).cast("int").alias("shard_index"),
        F.when((F.col("code_no") + F.hour("trade_time")) % 5 != 0, F.col("amount")).alias("gappy"),
    )


def schema_intersection(panels: list[DataFrame]) -> list[str]:
    """Columns that all panels have, in order of name."""
    common = set(panels[0].columns).intersection(*(set(p.columns) for p in panels[1:])) if panels else set()
    return sorted(common)


def number_in_name(path: str) -> int | None:
    found = re.search(r"shard_(\d+)", path)
    return int(found[1]) if found else None


def minute_of_day(column: str) -> Column:
    return F.hour(column) * 60 + F.minute(column)
