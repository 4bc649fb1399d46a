"""Registered queries of this subpackage: one per operator, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .context_mixing import lm_scores
from .decontamination import contamination_report
from .license_scan import scan_licenses
from .line_dedup import line_report
from .minhash_dedup import near_dup_report
from .mixing import mix_report
from .passage_dedup import repeated_passages
from .quality_classifier import quality_scores
from .quality_rules import quality_report
from .reversed_search import search_report
from .simhash_anchors import simhash_report
from .spectrum_slicing import whitening_report
from .toxicity import toxicity_report


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def q_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def q_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def q_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def q_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def q_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"))


def q_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_report(_table(spark, sf_dir, "documents"))


def q_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def q_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def q_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(_table(spark, sf_dir, "documents"))


def q_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def q_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(_table(spark, sf_dir, "embeddings"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": q_decontamination,
    "op2_line_dedup": q_line_dedup,
    "op3_toxicity": q_toxicity,
    "op4_substring_dedup": q_substring_dedup,
    "op5_quality_classifier": q_quality_classifier,
    "op6_lm_scoring": q_lm_scoring,
    "op7_source_mixing": q_source_mixing,
    "op8_minhash_near_dedup": q_minhash_near_dedup,
    "op9_license_scan": q_license_scan,
    "op10_quality_rules": q_quality_rules,
    "op11_simhash_near_dedup": q_simhash_near_dedup,
    "op12_lexical_search": q_lexical_search,
    "op13_embedding_whitening": q_embedding_whitening,
}

SQL: dict[str, str] = oracle.SQL
