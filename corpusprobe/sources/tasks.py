"""Cached evaluation tasks and datasets (SRC8-SRC13).

A cached task split is described by ``info.{split}.json``:
``{"features": {name: {"shape": [...], "dtype": "..."}}, "num_shards": n}`` and
stored in shards ``{split}.*-of-*{n}``. The record codec of the reference is
not rebuilt; shards are read as Parquet or JSON lines, with the schema built
from the info file and every feature cast back to its declared dtype (int32
and bool are stored as int64).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DataType, DoubleType, FloatType,
                               IntegerType, LongType, StructField, StructType)

# Declared dtypes and their Spark types.
DTYPES: dict[str, DataType] = {
    "int32": IntegerType(), "int64": LongType(), "bool": BooleanType(),
    "float32": FloatType(), "float64": DoubleType(), "string": BinaryType(), "bytes": BinaryType(),
}
STORED_AS = {"int32": "int64", "bool": "int64"}
# Split preference, most preferred first.
SPLIT_ORDER = ["test", "validation"]


def feature_type(shape, dtype: str) -> DataType:
    """A feature's Spark type: a variable (or fixed) first dim becomes an array."""
    base = DTYPES[dtype]
    for _ in shape or []:
        base = ArrayType(base)
    return base


def schema_from_info(info: dict, stored: bool = False) -> StructType:
    """The record schema; ``stored=True`` gives the on-disk types (int32/bool as int64)."""
    fields = []
    for name, desc in info["features"].items():
        dtype = STORED_AS.get(desc["dtype"], desc["dtype"]) if stored else desc["dtype"]
        fields.append(StructField(name, feature_type(desc.get("shape"), dtype)))
    return StructType(fields)


def read_info(spark: SparkSession, cache_dir: str, split: str) -> dict:
    text = spark.read.text(f"{cache_dir.rstrip('/')}/info.{split}.json", wholetext=True).first()
    return json.loads(text["value"])


def cast_to_declared(df: DataFrame, info: dict) -> DataFrame:
    """Cast every feature back to the type declared in the info file."""
    return df.select(*[F.col(name).cast(feature_type(desc.get("shape"), desc["dtype"])).alias(name)
                       for name, desc in info["features"].items()])


def load_cached_task(spark: SparkSession, cache_dir: str, split: str, fmt: str = "parquet") -> DataFrame:
    """SRC8: all shards of a split, typed by the info file."""
    info = read_info(spark, cache_dir, split)
    pattern = f"{cache_dir.rstrip('/')}/{split}.*-of-*{info['num_shards']}"
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.schema(schema_from_info(info, stored=True))
    return cast_to_declared(reader.load(pattern), info)


def decode_inputs(df: DataFrame, col: str = "inputs_pretokenized", keep: list[str] | None = None) -> DataFrame:
    """SRC9: the prompt text, UTF-8 decoded from bytes, beside the columns ``keep``."""
    return df.select(*(keep or []), F.decode(F.col(col), "UTF-8").alias("text"))


def split_fallback(tasks: DataFrame, available: DataFrame) -> DataFrame:
    """SRC10: per task the preferred available split, null when none.

    ``tasks(task)``, ``available(task, split)``. Left join from the task list,
    so tasks with no usable split stay as a null row.
    """
    pri = F.array_position(F.array(*[F.lit(s) for s in SPLIT_ORDER]), F.col("split"))
    best = (available.where(pri > 0).groupBy("task")
            .agg(F.min(pri).alias("p")))
    names = F.array(*[F.lit(s) for s in SPLIT_ORDER])
    return (tasks.select("task").distinct().join(best, "task", "left")
            .select("task", F.when(F.col("p").isNotNull(), F.element_at(names, F.col("p").cast("int")))
                    .alias("split")))


def pending_tasks(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """SRC11: tasks whose output does not exist yet (anti join)."""
    return tasks.select("task").distinct().join(done.select("task"), "task", "left_anti")


def done_from_outputs(spark: SparkSession, output_dir: str) -> DataFrame:
    """Tasks that :func:`corpusprobe.sources.sinks.write_prompts` has written
    under ``output_dir``, those without prompts included."""
    from corpusprobe.sources.prompts import written_prompts
    return written_prompts(spark, output_dir).select("task").distinct()


def available_splits(spark: SparkSession, cache_root: str) -> DataFrame:
    """``(task, split)`` of every split that has an info file in the task
    folders below ``cache_root`` (a listing of names, no data is read)."""
    from corpusprobe.sources.prompts import _list_files
    root = cache_root.rstrip("/")
    rows = [(task, name.split(".", 1)[0].removesuffix("_info").removeprefix("info_"))
            for task, is_dir in _list_files(spark, root) if is_dir
            for name, inner in _list_files(spark, f"{root}/{task}") if not inner and name.startswith("info")]
    return spark.createDataFrame(rows, "task string, split string")


def load_dataset(spark: SparkSession, name: str | None = None, config: str | None = None, *, split: str | None = None,
                 path: str | None = None, fmt: str = "json", root: str | None = None) -> DataFrame:
    """SRC13: a dataset by name, and optionally its configuration and split, or files by path; exactly one of them.

    With ``root``, the dataset ``name`` is a folder of data files,
    ``root/name[/config]/split*``. Without, it is a table of the catalog, whose columns
    ``config`` and ``split`` (partitions, usually) are filtered and dropped.
    """
    if (name is None) == (path is None):
        if name is not None:
            raise ValueError("load_dataset takes a name or a path, not the two together")
        raise NotImplementedError("load_dataset needs a name or a path")
    if path is not None:
        if config is not None:
            raise ValueError("a path has no configuration")
        return spark.read.format(fmt).load(path if split is None else f"{path.rstrip('/')}/{split}*")
    if root is not None:
        folder = "/".join([root.rstrip("/"), name, *([config] if config else [])])
        return spark.read.format(fmt).load(folder if split is None else f"{folder}/{split}*")
    rows = spark.table(name)
    for column, wanted in (("config", config), ("split", split)):
        if wanted is not None:
            if column not in rows.columns:
                raise ValueError(f"table {name} has no column {column}")
            rows = rows.where(F.col(column) == wanted).drop(column)
    return rows


__all__ = ["schema_from_info", "load_cached_task", "decode_inputs", "split_fallback",
           "pending_tasks", "load_dataset", "cast_to_declared"]
