"""Corpus pipeline: five stages over ``documents``, each stored and reread.

1. quality rules: documents outside the adaptive fences go;
2. line dedup: later copies of repeated three-line windows are cut out;
3. MinHash near-dedup: one document of each group stays;
4. benchmark decontamination: documents with a benchmark window go;
5. mixing: every remaining document gets its place in the weighted mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusprobe.llm.common import scratch_table
from corpusprobe.llm.decontamination import drop_contaminated
from corpusprobe.llm.line_dedup import drop_repeated_lines
from corpusprobe.llm.minhash_dedup import drop_near_duplicates
from corpusprobe.llm.mixing import mix
from corpusprobe.llm.quality_rules import filter_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Pfair interleaving is a simulation; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are stored as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
