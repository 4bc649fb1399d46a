"""Word lists and word-scramble probing (SRC14, FLT1-FLT4, TRF8, AGG4-AGG5).

The reference counts every (word, transformed query) with one external
process per query. Here all queries of all words and transforms are generated
as rows, deduplicated once, counted with one :func:`occurrence_counts` job and
joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprobe.functions.text import unnest, ws_tokens
from corpusprobe.functions.wordforms import TRANSFORMS, combine, select_transforms
from corpusprobe.operators.ngrams import dense_index
from corpusprobe.operators.occurrences import occurrence_counts
from corpusprobe.operators.places import token_tally, ws_token_array
from corpusprobe.session import ensure_checkpoint_dir


def word_counts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``: whitespace-token frequencies (counted per chunk of texts in the tasks)."""
    return token_tally(corpus, F.col(text_col), ws_token_array).withColumnRenamed("token", "word")


def word_frequencies(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """SRC14 derived from the corpus: ``(rank, word, n)``, most frequent first.

    Ties are ordered by word; ranks are 0-based positions in the list, assigned
    by range partitioning (no single-partition window).
    """
    counts = word_counts(corpus, text_col)
    ranked = dense_index(counts, "word", "rank", order=[F.col("n").desc(), F.col("word").asc()])
    return ranked.select("rank", "word", F.col("n").cast("bigint").alias("n"))


def read_frequency_list(spark, path: str) -> DataFrame:
    """SRC14 from a file: first whitespace field of each line, ``(rank, word)``.

    Line order is the list order; it is recovered from the file offset, so the
    file may be split across tasks.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("m"),
        F.element_at(ws_tokens("value"), 1).alias("word"))
    ranked = dense_index(raw.where(F.col("word").isNotNull()), "m", "rank",
                         order=[F.col("f"), F.col("b"), F.col("m")])
    return ranked.select("rank", "word")


def test_words(freq: DataFrame, limit: int = 10000, min_len: int = 5, max_len: int = 14) -> DataFrame:
    """FLT1 + FLT2: the first ``limit`` words with ``min_len <= len <= max_len``.

    ``freq`` is a ranked list ``(rank, word)`` or counts ``(word, n)`` (list
    order = n descending, then word). ``(idx, word)``; the limit is the feature
    (a top-k), so only ``limit`` rows reach the final numbering window.
    """
    order = [F.col("rank")] if "rank" in freq.columns else [F.col("n").desc(), F.col("word")]
    picked = (freq.where(F.length("word").between(min_len, max_len))
              .orderBy(*order).limit(limit))
    return picked.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint").alias("idx"),
                         "word")


def word_slice(words: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """FLT3: ``words[start:end]`` by list position."""
    cond = F.col("idx") >= start
    if end is not None:
        cond = cond & (F.col("idx") < end)
    return words.where(cond)


def transform_queries(words: DataFrame, transforms=None, n_outputs: int = 5,
                      combine_with_word: bool = False) -> DataFrame:
    """TRF1-TRF7 + FLT4: ``(transform, word, query)``, distinct per word.

    Outputs equal to the word are dropped; with ``combine_with_word`` each
    output becomes the eight word/output pairings.
    """
    chosen = select_transforms(transforms) if transforms is not None else TRANSFORMS
    w = F.col("word")
    parts = []
    for name, fn in chosen.items():
        outs = F.filter(fn(w, n_outputs), lambda x: x != w)
        if combine_with_word:
            outs = F.flatten(F.transform(outs, lambda t: combine(t, w)))
        parts.append(unnest(words, F.array_distinct(outs), F.lit(name).alias("transform"), "word", name="query"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def transform_counts(corpus: DataFrame, words: DataFrame, transforms=None, n_outputs: int = 5,
                     combine_with_word: bool = False, **kw) -> DataFrame:
    """AGG4: ``(transform, word, query, n)``; queries are counted once overall.

    The words (read once a transform) and the (transform, word, query) table (read by the
    count and the join back) are each written once to the shared checkpoint folder.
    """
    ensure_checkpoint_dir(corpus.sparkSession)
    q = transform_queries(words.select("word").checkpoint(), transforms, n_outputs, combine_with_word).checkpoint()
    counts = occurrence_counts(corpus, q, **kw)
    return q.join(counts, "query", "left").select(
        "transform", "word", "query", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def transform_avg_count(counts: DataFrame) -> DataFrame:
    """AGG5: mean count over all (word, query) pairs of a transform."""
    return counts.groupBy("transform").agg(F.avg("n").alias("avg_n"))
