"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; keeps a batch of very long texts to tens of MB.
ARROW_ROWS = 512

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN_DIR:
        _OWN_DIR[context.applicationId] = tempfile.mkdtemp(prefix="spindrift-")
    return _OWN_DIR[context.applicationId]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote and nothing will read again; other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as __) for what is written inside; the old ones come back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: For tables of narrow rows without texts.
LARGE_BATCHES = {"spark__sql__execution__arrow__maxRecordsPerBatch": "65536"}


def use_small_batches(spark: SparkSession) -> None:
    """Bound the memory that texts of any length take: small Arrow batches, and Parquet pages in zstd.

    Snappy pages are unpacked into buffers outside the heap that are only given back when the
    heap is collected, which a task that hands texts to Python hardly ever causes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't use."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def row_marks(df: DataFrame) -> list:
    """Two hashes of a whole row (128 bits tell any number of rows apart); nested columns go in as JSON, which also tells where their nulls are."""
    columns = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        columns.append(F.to_json(F.struct(column)) if any(x in f.dataType.simpleString() for x in ("<", "variant")) else column)
    # A null is skipped by the hash, so the places of the nulls go in, too.
    nulls = F.concat(*[F.when(F.col(f"`{f.name}`").isNull(), "0").otherwise("1") for f in df.schema.fields])
    return [F.xxhash64(nulls, *columns), F.xxhash64(F.lit("second"), nulls, *columns)]


def id_bucket(column: str, modulus: int):
    """crc32 of the id's text form, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
