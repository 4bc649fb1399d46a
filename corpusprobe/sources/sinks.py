"""Sinks (SNK1-SNK8). All writes are distributed: one file set per partition
value, never a single driver-side file. JSON keeps the reference's formats
readable; Parquet replaces pickles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _dynamic(df: DataFrame):
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")


def write_prompts(prompts: DataFrame, path: str, tasks: DataFrame | None = None) -> None:
    """SNK1: prompts of each task and split, partitioned by both.

    Splits of ``tasks(task, split)`` without any prompt get one row of nulls, so
    that they count as finished, also beside another split of the same task.
    ``prompts.written_prompts`` reads it back.
    """
    if tasks is not None:
        empty = (tasks.select("task", "split").distinct()
                 .join(prompts.select("task", "split").distinct(), ["task", "split"], "left_anti")
                 .select("task", "split", F.lit(None).cast("bigint").alias("prompt_id"), F.lit(None).cast("string").alias("text")))
        prompts = prompts.select("task", "split", "prompt_id", "text").unionByName(empty)
    _dynamic(prompts).partitionBy("task", "split").json(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """SNK2: ``(task, query, n)``; a rerun replaces only the tasks it wrote."""
    _dynamic(counts).partitionBy("task").json(path)


def write_flags(per_task: DataFrame, per_prompt: DataFrame, path: str) -> None:
    """SNK3: ``flagged_per_task`` and ``flagged_queries`` side by side."""
    per_task.write.mode("overwrite").json(f"{path.rstrip('/')}/flagged_per_task")
    per_prompt.write.mode("overwrite").json(f"{path.rstrip('/')}/flagged_queries")


def write_transform_counts(counts: DataFrame, averages: DataFrame, path: str) -> None:
    """SNK4: per-word counts and the average, one folder per transform."""
    _dynamic(counts).partitionBy("transform").json(f"{path.rstrip('/')}/per_word_count")
    _dynamic(averages).partitionBy("transform").json(f"{path.rstrip('/')}/avg_count")


def write_token_lines(lines: DataFrame, path: str, keep_order: bool = False) -> None:
    """SNK5: one line of space-joined ids per document. ``keep_order`` sorts by
    ``doc_id`` (range-partitioned) so part files concatenate in input order."""
    out = lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id") if keep_order else lines
    out.select("line").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """SNK6: n-gram sets / indexes as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_embeddings(df: DataFrame, path: str, fmt: str = "json") -> None:
    """SNK7: the embedded dataset with all its columns."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_word_list(words: DataFrame, path: str) -> None:
    """SNK8: the test-word list (a top-k list, so of bounded length) as one
    JSON array in list order, which ``corpus.read_word_list`` reads back."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"])
    words.agg(F.to_json(ordered).alias("value")).write.mode("overwrite").text(path)

