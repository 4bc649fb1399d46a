"""Corpus and word-list readers (SRC6, SRC7, SRC15)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def located_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, position, terminated, line)``: the lines of text files and where they stand.

    ``line_no`` counts from 0 in each file, ``position`` is the line's first byte counted
    over all files in path order, and ``terminated`` tells whether a line feed ends it.
    None of them depends on splits, cores or retries: one pass adds up the lines and
    bytes of each split, the second one counts on from the sums of the splits before.
    The sums are a row a split; they pass the driver and are broadcast. Lines end at a line
    feed; a carriage return before it is not part of the line.
    """
    raw = (spark.read.option("lineSep", "\n").text(path)
           .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.col("_metadata.file_size").alias("file_size")))
    size = (F.octet_length("value") + 1).cast("bigint")
    splits = (raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"), F.sum(size).alias("bytes"),
                                               F.max("file_size").alias("file_size")).collect())
    starts, position, file, line_no, inside = [], 0, None, 0, 0
    for s in sorted(splits, key=lambda r: (r["file"], r["block"])):
        if s["file"] != file:
            position += inside
            file, line_no, inside = s["file"], 0, 0
        starts.append((file, s["block"], line_no, inside, position))
        line_no, inside = line_no + s["lines"], inside + s["bytes"]
    starts = spark.createDataFrame(starts, "file string, block bigint, line_0 bigint, byte_0 bigint, file_0 bigint")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a task come split by split, each in file order."""
        split, lines, size = None, 0, 0
        for batch in batches:
            files, blocks = batch.column("file"), batch.column("block")
            lengths = pc.add(pc.binary_length(batch.column("value").cast(pa.binary())), 1).to_numpy()
            nth, before, at = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
            while at < len(lengths):
                here = (files[at].as_py(), blocks[at].as_py())
                if here != split:
                    split, lines, size = here, 0, 0
                same = pc.and_(pc.equal(files.slice(at), here[0]), pc.equal(blocks.slice(at), here[1]))
                end = pc.index(same, False).as_py()
                end = len(lengths) if end < 0 else at + end
                nth[at:end] = lines + np.arange(end - at)
                ends = np.cumsum(lengths[at:end], dtype=np.int64)
                before[at:end] = size + ends - lengths[at:end]
                lines, size, at = lines + end - at, size + int(ends[-1]), end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth), pa.array(before)],
                                             names=[*batch.schema.names, "nth", "before"])

    rows = raw.mapInArrow(counted, "value string, file string, block bigint, file_size bigint, nth bigint, before bigint")
    byte = F.col("byte_0") + F.col("before")
    return rows.join(F.broadcast(starts), ["file", "block"]).select(
        "file", (F.col("line_0") + F.col("nth")).alias("line_no"), (F.col("file_0") + byte).alias("position"),
        (byte + F.octet_length("value") < F.col("file_size")).alias("terminated"),
        F.regexp_replace("value", "\r$", "").alias("line"))


def read_jsonl_corpus(spark: SparkSession, path: str, text_key: str = "text") -> DataFrame:
    """SRC6: one JSON object per line; only the text field is parsed.

    ``(doc_id, text)``; ``doc_id`` is the byte position of the line over all files in path
    order: unique, rising, and the same however the files are split. Lines that are
    no JSON object have a null text.
    """
    parsed = F.from_json("line", f"`{text_key}` string")
    return located_lines(spark, path).where(F.length(F.trim("line")) > 0).select(
        F.col("position").alias("doc_id"), parsed.getField(text_key).alias("text"))


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: raw text lines, ``(doc_id, line_no, line)`` with one pseudo-document
    per file. ``line_no`` is the line's number in it, from 0, however the file is split."""
    return located_lines(spark, path).select(F.xxhash64("file").alias("doc_id"), "line_no", "line")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: a JSON array of words, ``(idx, word)`` in list order."""
    raw = spark.read.text(path, wholetext=True)
    return (raw.select(F.from_json("value", "array<string>").alias("a"))
            .select(F.posexplode("a").alias("idx", "word"))
            .select(F.col("idx").cast("bigint"), "word"))
