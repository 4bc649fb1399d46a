"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "corpusprobe",
              shuffle_partitions: int | None = None,
              driver_memory: str = "16g") -> SparkSession:
    """A session tuned for this library.

    Only what is unset is set, so spark-submit's master, memory, partitions
    and split size hold; without any master it runs locally, on ``BENCH_CPUS``
    cores with as many shuffle partitions. ``driver_memory`` counts if this starts
    the JVM, whose heap can't be changed later.
    """
    if SparkContext._gateway is None and "PYSPARK_SUBMIT_ARGS" not in os.environ:
        os.environ["PYSPARK_SUBMIT_ARGS"] = f"--driver-memory {driver_memory} pyspark-shell"
    SparkContext._ensure_initialized()  # makes spark-submit's settings visible below
    given = SparkConf()
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    chosen = master or given.get("spark.master", os.environ.get("SPARK_MASTER") or f"local[{cpus}]")
    wanted["spark.master"] = chosen
    if chosen.startswith("local"):
        wanted |= {"spark.driver.memory": driver_memory, "spark.sql.shuffle.partitions": cpus,
                   "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)}
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    unset = {k: v for k, v in wanted.items() if not given.contains(k)}
    spark = SparkSession.builder.appName(app).config(map=unset).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; only when it is unset
    (local runs, tests) a private scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="corpusprobe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in here go when it has run, not when the driver's JVM happens to collect them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as compressed Parquet to the shared checkpoint folder and read back.

    Like a checkpoint it cuts the lineage; it takes a fraction of the disk."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
