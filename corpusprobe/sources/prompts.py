"""Prompt sets (SRC1-SRC5, SRC12) and the stand-in test tables.

A prompt folder holds one file per task: a JSON list of prompt strings (or
``null``) or a text file with one prompt per line. The file name is the task.
Sub-directories are skipped; any other extension is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprobe.sources.corpus import located_lines

SUPPORTED = ("json", "txt")
PROMPT_SCHEMA = "task string, prompt_id bigint, text string"


def _list_files(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """Names of the entries directly in ``folder`` and whether each is a dir.

    Directory listing is metadata, so it runs on the driver through the Hadoop
    file system of the session (works for any scheme Spark can read).
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(st.getPath().getName(), st.isDirectory()) for st in fs.listStatus(path)]


def read_prompt_folder(spark: SparkSession, folder: str, strip_newline: bool = True) -> DataFrame:
    """``(task, prompt_id, text)`` for all prompt files in ``folder``.

    ``strip_newline=True`` drops the line terminator of text prompts (the
    occurrence counter does that; the tile searches keep it, pass False).
    A ``null`` JSON file contributes no rows.
    """
    exts = set()
    for name, is_dir in _list_files(spark, folder):
        if is_dir:
            continue
        ext = name.rsplit(".", 1)[-1]
        if ext not in SUPPORTED:
            raise NotImplementedError(f"prompt files end in {SUPPORTED}, not .{ext}")
        exts.add(ext)
    parts = []
    base = folder.rstrip("/")
    if "json" in exts:
        raw = spark.read.text(f"{base}/*.json", wholetext=True)
        parts.append(
            raw.select(F.col("_metadata.file_name").alias("file"),
                       F.from_json("value", "array<string>").alias("arr"))
            .where(F.col("arr").isNotNull())
            .select("file", F.posexplode("arr").alias("prompt_id", "text")))
    if "txt" in exts:
        # Line by line, so that a long file is many tasks; the last line may have no terminator.
        lines = located_lines(spark, f"{base}/*.txt")
        text = F.col("line") if strip_newline else F.concat("line", F.when(F.col("terminated"), F.lit("\n")).otherwise(F.lit("")))
        parts.append(lines.select(F.url_decode(F.element_at(F.split("file", "/"), -1)).alias("file"),
                                  F.col("line_no").alias("prompt_id"), text.alias("text")))
    if not parts:
        raise FileNotFoundError(f"no prompt files in {folder}; written prompt tables are read by written_prompts")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("file").alias("task"), F.col("prompt_id").cast("bigint"), "text")


WRITTEN_SCHEMA = "task string, split string, prompt_id bigint, text string"


def written_prompts(spark: SparkSession, path: str) -> DataFrame:
    """What ``sinks.write_prompts`` wrote under ``path`` (nothing yet: no rows).

    A finished task without prompts has one row with a null ``prompt_id``.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], WRITTEN_SCHEMA)
    return spark.read.schema(WRITTEN_SCHEMA).json(path).select("task", "split", "prompt_id", "text")


def read_written_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``(task, split, prompt_id, text)`` of all written prompts."""
    return written_prompts(spark, path).where("prompt_id is not null")


def read_task_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: one task name per line, ``(task)``; blank lines dropped."""
    return (spark.read.text(path)
            .select(F.col("value").alias("task"))
            .where(F.length("task") > 0))


# ------------------------------------------------------------- test tables

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def benchmark_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from ``benchmark``: task ``task_<item_id % 4>``, prompt id = item id."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("task_"), (F.col("item_id") % 4).cast("string")).alias("task"),
                    F.col("item_id").alias("prompt_id"), "text")


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core for per-document CPU work.

    A big corpus has far more file splits than cores and is left as read; a
    scan with fewer splits than ``defaultParallelism`` (few row groups) is
    hash-partitioned on ``doc_id`` (deterministic on retry, no sort).
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus ``(doc_id, text)`` from ``documents``."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
