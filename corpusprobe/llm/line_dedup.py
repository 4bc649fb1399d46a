"""Line dedup over overlapping windows of three consecutive lines.

A line window is hashed to 128 bits; windows that occur more than once are
found by one global aggregation, the first occurrence in (doc_id, line) order
stays, and every line that some later occurrence covers is removed. Covered
positions of overlapping windows merge in the set of line numbers per document.

Defined results: a document of fewer than three lines, a null text and a
window of three blank lines are never touched; null ids order last; rows alike
in id and text count as one document and are cleaned alike; an empty table
gives an empty result; extra columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS

WINDOW_LINES = 3


def _doc_key(doc_id: str, text: str) -> Column:
    """Orders as the id does (nulls last), and tells texts of one id apart."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"),
                    F.xxhash64(text).alias("text_hash"))


def line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per window: ``key`` of the document, ``line`` it starts at, ``h1``, ``h2``."""
    k = WINDOW_LINES
    lines = docs.select(_doc_key(doc_id, text).alias("key"), F.split(F.col(text), "\n").alias("lines"))
    wins = F.when(F.size("lines") >= k, F.transform(
        F.sequence(F.lit(1), F.size("lines") - (k - 1)), lambda i: F.slice("lines", i, k)))
    return (lines.select("key", F.posexplode(wins).alias("line", "win"))
            .where(F.exists("win", lambda x: x.rlike(f"[^{SPACE_CHARS}]")))
            .select("key", "line", F.xxhash64("win").alias("h1"),
                    F.xxhash64(F.lit("second"), F.reverse("win")).alias("h2")))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` of a document and the sorted 0-based ``lines`` it loses."""
    wins = line_windows(docs, doc_id, text)
    first = (wins.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("key", "line")).alias("first"))
             .where("n > 1").select("h1", "h2", "first"))
    later = (wins.join(first, ["h1", "h2"]).where(F.struct("key", "line") > F.col("first"))
             .select("key", F.explode(F.sequence("line", F.col("line") + (WINDOW_LINES - 1))).alias("line")))
    return later.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` as struct ``row``, with ``clean_text``, ``n_lines``
    and ``n_removed`` (0 lines for a null text)."""
    lost = repeated_lines(docs, doc_id, text).select(F.col("key").alias("lost_key"), "lines")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _doc_key(doc_id, text).alias("key"))
    # Equality of the parts, so that null ids match each other.
    on = (F.col("key.text_hash") == F.col("lost_key.text_hash")) & F.col("key.id").eqNullSafe(F.col("lost_key.id"))
    old = F.split(F.col(f"row.{text}"), "\n")
    kept = F.filter(old, lambda x, i: ~F.array_contains("lines", i))
    return rows.join(lost, on, "left").select(
        "row", F.when(F.col("lines").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
        F.coalesce(F.size(old), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"))


def line_report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_removed", "clean_text")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with the repeated lines cut out and ``n_chars`` renewed;
    a document all of whose lines went goes too."""
    out = dedup_lines(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    new = {"text": F.col("clean_text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars"))
           .otherwise(F.length("clean_text").cast("long"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
