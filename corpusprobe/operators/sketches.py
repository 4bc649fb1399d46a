"""Approximate distinct counts from stored, mergeable sketches (AGG7).

A sketch of each corpus part (a day, a source, a crawl) is written once; when
parts arrive or are chosen, their sketches are united, and no n-gram is read
again. Sketches are Spark's HyperLogLog sketches (DataSketches) with
``2**lg_k`` registers: relative standard error ``ERROR / sqrt(2**lg_k)``,
0.81 % at the default, and about ``2**lg_k`` bytes at most for a part of any size.
A union has the same registers as the sketch of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14
#: Relative standard error of the sketch times the root of its registers.
ERROR = 1.04


def sketch_values(values: DataFrame, value_col: str, *part_cols: str, lg_k: int = LG_K) -> DataFrame:
    """``(*part_cols, sketch)``: one sketch of ``value_col`` for each part; partial aggregation, no distinct."""
    return values.groupBy(*part_cols).agg(F.hll_sketch_agg(value_col, lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, *part_cols: str) -> DataFrame:
    """The union of the sketches of each part of ``part_cols`` (of all, without one)."""
    return sketches.groupBy(*part_cols).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_cardinality(sketches: DataFrame, name: str = "n") -> DataFrame:
    """The sketch column replaced by its estimate."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


def add_part(stored: DataFrame, values: DataFrame, value_col: str, *part_cols: str, lg_k: int = LG_K) -> DataFrame:
    """Stored sketches with those of new rows; a part that is there already is united with its new rows."""
    return merge_sketches(stored.unionByName(sketch_values(values, value_col, *part_cols, lg_k=lg_k)), *part_cols)
