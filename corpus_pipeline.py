"""From raw documents to a training mix: reject, deduplicate, decontaminate, redact, mix.

Each stage takes what its predecessor kept. All but the last return the columns of
documents; the last adds how often the mix takes each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import toxicity
from spindrift.llm.common import materialize, table
from spindrift.llm.contamination import drop_contaminated
from spindrift.llm.mixing import mix
from spindrift.llm.secrets import redact_secrets
from spindrift.llm.simhash import drop_near_duplicates


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from the labelled ones among them.

    Null and empty texts stay; equal rows go or stay together; without usable labels the
    fixed lexicon decides; an empty table gives an empty one. Extra columns stay.
    """
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id.

    Null and empty texts are one group, a null id comes last, of rows equal in all columns
    one stays; an empty table gives an empty one. Extra columns stay.
    """
    return drop_near_duplicates(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts stay; items without words match nothing; with an empty benchmark
    all stay; an empty table gives an empty one. Extra columns of either table don't matter.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them masked and n_chars renewed where a text changed. Null texts stay null."""
    return redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies: how often each."""
    return mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_dedup", keep_one_of_each_group),
    ("decontamination", reject_contaminated),
    ("secrets", redact),
    ("mixing", mix_sources),
]

#: SQL can't express these stages; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what lies between two is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
