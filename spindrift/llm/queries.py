"""Queries of the training-data operators: thin digests over the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.common import table
from spindrift.llm.contamination import find_contamination
from spindrift.llm.html_text import extract_text
from spindrift.llm.language import identify_languages
from spindrift.llm.mixing import mix_plan
from spindrift.llm.quality import ORACLE_SQL as QUALITY_SQL
from spindrift.llm.quality import quality_rules
from spindrift.llm.repeats import repeated_passages
from spindrift.llm.secrets import find_secrets
from spindrift.llm.simhash import simhash_duplicates
from spindrift.llm.token_counts import token_counts
from spindrift.llm.toxicity import classify_toxicity


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_html_text": op5_html_text,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_contamination": op8_contamination,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
}

ORACLE: dict[str, str] = {
    "op9_quality": QUALITY_SQL,
}
