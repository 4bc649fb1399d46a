"""Helpers shared by the operators of this subpackage.

* :func:`scratch_table` cuts lineage with a Parquet table in the shared folder
  the session names in ``spark.checkpoint.dir`` (never a machine-local one).
* :func:`fits` is the size check in front of every broadcast.
* The word rules of the query contracts, for Python tasks and for columns.
"""

from __future__ import annotations

import tempfile
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the "space" word rule (U+0020, U+0009 to U+000D).
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: bytes.translate table of the "alphanumeric" word rule: A-Z become a-z, every
#: other ASCII byte but 0-9 and a-z becomes a space, other bytes stay.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))


def space_words(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, runs of bytes outside ``SPACE_CHARS`` (bytes.lower and
    bytes.split touch ASCII only, so UTF-8 sequences stay whole)."""
    return raw.lower().split()


def alnum_words(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, runs of 0-9, a-z and everything outside ASCII."""
    return raw.translate(ALNUM_TABLE).split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def text_bytes(batch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of one string column of an Arrow batch; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without; there a temporary folder is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corpusprobe-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_table(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Lost executors cost a re-read only. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def fits(table: DataFrame, max_rows: int) -> bool:
    """True if a stored table has at most ``max_rows`` rows: the proven bound
    that a broadcast of narrow rows needs."""
    return table.limit(max_rows + 1).count() <= max_rows


def broadcast_if(table: DataFrame, max_rows: int) -> DataFrame:
    return F.broadcast(table) if fits(table, max_rows) else table


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
