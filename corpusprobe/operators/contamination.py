"""Contamination search: which prompts share a long passage with the corpus.

Prompts are a DataFrame ``(task, prompt_id, text)``. Every search cuts the
prompts into tiles, counts the *distinct* tiles once with
:func:`occurrence_counts` (a tile shared by many prompts or tasks is searched
once; its options such as ``tokens=True`` can be given to every search), joins the hits back and aggregates per prompt and per task.

The halving searches of the reference loop from a coarse scale down until a tile
hits. Here all scales are tiled at once and the loop result is recovered with
conditional aggregates (no driver loop, one job).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprobe.functions.text import (WS_CLASS, fixed_tile, fixed_tile_starts, halving_scales,
                                        power_log, ws_tokens)
from corpusprobe.operators.occurrences import occurrence_counts

PROMPT_KEYS = ["task", "prompt_id"]


def normalize_whitespace(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """Q7 option: every whitespace run of the corpus becomes one space, so a
    tile (words joined by one space) also matches across newlines or double
    spaces."""
    return corpus.withColumn(text_col, F.regexp_replace(F.col(text_col), WS_CLASS + "+", " "))


def _tile_hits(corpus: DataFrame, tiles: DataFrame, normalize_ws: bool = False, **kw) -> DataFrame:
    """Attach ``hit`` (tile occurs in the corpus) to every tile row."""
    if normalize_ws:
        corpus = normalize_whitespace(corpus)
    counts = occurrence_counts(corpus, tiles.select(F.col("tile").alias("query")), **kw)
    hits = counts.select(F.col("query").alias("tile"), (F.col("n") > 0).alias("hit"))
    return tiles.join(hits, "tile", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def prompt_counts(prompts: DataFrame, corpus: DataFrame, **kw) -> DataFrame:
    """OCC3: ``(task, prompt_id, n)``, occurrences of every whole prompt."""
    counts = occurrence_counts(corpus, prompts, query_col="text", **kw)
    return (prompts.select(*PROMPT_KEYS, F.col("text").alias("query")).join(counts, "query", "left")
            .select(*PROMPT_KEYS, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


# ---------------------------------------------------------------- failed lookups

def checked_prompts(prompts: DataFrame, text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """OCC5: ``prompts`` with ``text`` (null where it can't be looked up) and ``error``, the reason.

    ``text_col`` is a string or the raw bytes of one. Reasons: ``null text``, ``invalid utf-8``,
    ``empty text`` and, with ``max_chars``, ``too long``. No row fails the job.
    """
    raw = F.col(text_col)
    valid = F.try_validate_utf8(raw.cast("string"))
    error = (F.when(raw.isNull(), "null text").when(valid.isNull(), "invalid utf-8")
             .when(F.length(valid) == 0, "empty text"))
    if max_chars is not None:
        error = error.when(F.length(valid) > max_chars, "too long")
    marked = prompts.withColumn("error", error)
    return marked.withColumn("text", F.when(F.col("error").isNull(), valid))


def prompt_counts_checked(prompts: DataFrame, corpus: DataFrame, text_col: str = "text",
                          max_chars: int | None = None, **kw) -> DataFrame:
    """OCC3 with OCC5: ``(task, prompt_id, n, error)``; a failed lookup has a null count and its reason,
    never a count of 0."""
    marked = checked_prompts(prompts, text_col, max_chars).select(*PROMPT_KEYS, "text", "error")
    counts = occurrence_counts(corpus, marked.where(F.col("error").isNull()), query_col="text", **kw)
    return (marked.join(counts.withColumnRenamed("query", "text"), "text", "left")
            .select(*PROMPT_KEYS, F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).cast("bigint").alias("n"), "error"))


def lookup_report(checked: DataFrame) -> DataFrame:
    """OCC5: ``(task, prompts, failed, n)``: lookups, those that failed, and the sum of the counts found."""
    return checked.groupBy("task").agg(
        F.count(F.lit(1)).cast("bigint").alias("prompts"), F.count("error").cast("bigint").alias("failed"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


# ---------------------------------------------------------------- fixed length

def word_tiles(prompts: DataFrame, length: int = 16, min_words: int = 0) -> DataFrame:
    """TIL1: ``(task, prompt_id, tile_idx, tile)``; the last tile backs off.

    A prompt shorter than ``length`` is one tile (searched whole); prompts with
    fewer than ``min_words`` words get no tiles (Q6 option).
    """
    w = prompts.select(*PROMPT_KEYS, ws_tokens("text").alias("w"))
    if min_words > 0:
        w = w.where(F.size("w") >= min_words)
    return (w.select(*PROMPT_KEYS, "w", F.explode(fixed_tile_starts(F.size("w"), length)).alias("s"))
            .select(*PROMPT_KEYS, (F.col("s") / length).cast("int").alias("tile_idx"),
                    fixed_tile("w", "s", length).alias("tile")))


def fixed_length_search(prompts: DataFrame, corpus: DataFrame, length: int = 16,
                        min_words: int = 0, **kw) -> DataFrame:
    """CON1 + AGG3: one row per prompt.

    ``(task, prompt_id, text, flagged, tiles)`` where ``tiles`` are the matched
    tiles in tile order. Prompts without words are kept, not flagged.
    """
    tiles = _tile_hits(corpus, word_tiles(prompts, length, min_words), **kw)
    per_prompt = (tiles.groupBy(*PROMPT_KEYS)
                  .agg(F.bool_or("hit").alias("flagged"),
                       F.array_sort(F.collect_list(
                           F.when(F.col("hit"), F.struct("tile_idx", "tile")))).alias("m")))
    return (prompts.select(*PROMPT_KEYS, "text")
            .join(per_prompt, PROMPT_KEYS, "left")
            .select(*PROMPT_KEYS, "text",
                    F.coalesce("flagged", F.lit(False)).alias("flagged"),
                    F.coalesce(F.transform("m", lambda x: x["tile"]),
                               F.array().cast("array<string>")).alias("tiles")))


def flagged_per_task(flags: DataFrame, flag_col: str = "flagged") -> DataFrame:
    """AGG1: flagged prompt rows per task; tasks without flags stay with 0."""
    return flags.groupBy("task").agg(F.count_if(F.col(flag_col)).cast("bigint").alias("flagged"))


def flagged_texts_per_task(flags: DataFrame, flag_col: str = "flagged") -> DataFrame:
    """AGG2: distinct flagged prompt texts per task (the reference keys a dict by
    prompt text, so duplicates collapse)."""
    return flags.groupBy("task").agg(
        F.count_distinct(F.when(F.col(flag_col), F.col("text"))).cast("bigint").alias("flagged"))


# ---------------------------------------------------------------- halving, chars

def char_tiles(prompts: DataFrame, lower_bound: int = 64) -> DataFrame:
    """TIL2: every scale at once. ``(task, prompt_id, scale, k, tile)``."""
    n = F.length("text")
    sc = prompts.select(*PROMPT_KEYS, "text", F.explode(halving_scales(n, lower_bound)).alias("scale"))
    return (sc.select(*PROMPT_KEYS, "text", "scale",
                      F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.col("scale").cast("int")))
                      .alias("i"))
            .select(*PROMPT_KEYS, "scale", (F.col("i") / F.col("scale")).cast("int").alias("k"),
                    F.col("text").substr(F.col("i") + 1, F.col("scale").cast("int")).alias("tile")))


def halving_chars(prompts: DataFrame, corpus: DataFrame, lower_bound: int = 64, **kw) -> DataFrame:
    """CON2: ``(task, prompt_id, text, n_chars, longest, flagged)``.

    ``longest`` = 3 x the largest scale with a hitting tile, else the bound.
    """
    tiles = _tile_hits(corpus, char_tiles(prompts, lower_bound), **kw)
    top = tiles.where("hit").groupBy(*PROMPT_KEYS).agg(F.max("scale").alias("s1"))
    longest = F.coalesce(3 * F.col("s1"), F.lit(lower_bound)).cast("bigint")
    return (prompts.select(*PROMPT_KEYS, "text").join(top, PROMPT_KEYS, "left")
            .select(*PROMPT_KEYS, "text", F.length("text").cast("bigint").alias("n_chars"),
                    longest.alias("longest"), (longest > lower_bound).alias("flagged")))


# ---------------------------------------------------------------- halving, words

def halving_word_tiles(prompts: DataFrame, lower_bound: int = 16) -> DataFrame:
    """TIL3 with the scores of both search phases.

    ``(task, prompt_id, n_words, scale, k, tile, score1, score2)``; ``score2`` is
    null for tiles outside the prefix kept by a rump cut.
    """
    w = prompts.select(*PROMPT_KEYS, ws_tokens("text").alias("w"))
    n = F.size("w")
    sc = w.select(*PROMPT_KEYS, "w", F.explode(halving_scales(n, lower_bound)).alias("scale"))
    t = (sc.select(*PROMPT_KEYS, "w", "scale",
                   F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.col("scale").cast("int"))).alias("i"))
         .select(*PROMPT_KEYS, F.size("w").alias("n_words"), "scale",
                 (F.col("i") / F.col("scale")).cast("int").alias("k"),
                 F.least(F.col("scale"), F.size("w") - F.col("i")).alias("tw"),
                 F.array_join(F.slice("w", F.col("i") + 1, F.col("scale").cast("int")), " ").alias("tile")))
    s = F.col("scale")
    k = F.col("k")
    nt = F.ceil(F.col("n_words") / s)
    score1 = (F.when(k == 0, 2 * s).when(k == nt - 1, 2 * F.col("tw")).otherwise(3 * s))
    cut = (power_log(F.col("n_words")) / 2).cast("bigint")
    score2 = F.when((k + 1) * s <= cut,
                    F.when(k == 0, 2 * s).when(k == (cut / s).cast("bigint") - 1, 2 * s).otherwise(3 * s))
    return t.select(*PROMPT_KEYS, "n_words", "scale", "k", "tile",
                    score1.cast("bigint").alias("score1"), score2.cast("bigint").alias("score2"))


def halving_words(prompts: DataFrame, corpus: DataFrame, lower_bound: int = 16,
                  rump: str = "truncate", **kw) -> DataFrame:
    """CON3-CON6: ``(task, prompt_id, text, n_words, longest, rump, flagged)``.

    Phase 1: the largest scale s1 with a hit gives the max tile score there. If
    that is not above the bound, only a short last tile hit (the rump): the
    prompt is cut to power_log(n)/2 words and the search goes on below s1; no
    tile inside the cut can hit at scales >= s1, so phase 2 is the largest
    scale with a hit among the tiles inside the cut.

    ``rump="ignore"`` (Q9 option) keeps the whole prompt: the answer is the
    best score at the largest scale that has a tile scoring above the bound.
    """
    if rump not in ("truncate", "ignore"):
        raise ValueError("rump must be 'truncate' or 'ignore'")
    tiles = _tile_hits(corpus, halving_word_tiles(prompts, lower_bound), **kw)
    lb = F.lit(lower_bound).cast("bigint")
    agg = (tiles.where("hit").groupBy(*PROMPT_KEYS)
           .agg(F.max(F.struct("scale", "score1")).alias("top"),
                F.max(F.when(F.col("score2").isNotNull(), F.struct("scale", "score2"))).alias("low"),
                F.max(F.when(F.col("score1") > lb, F.struct("scale", "score1"))).alias("real")))
    top = F.col("top.score1")
    low = F.col("low.score2")
    if rump == "ignore":
        longest = F.coalesce(F.col("real.score1"), lb)
    else:
        longest = (F.when(F.col("top").isNull(), lb)
                   .when(top > lb, top)
                   .when(F.col("low").isNull(), lb)
                   .otherwise(low))
    rump_hit = F.col("top").isNotNull() & (top <= lb)
    return (prompts.select(*PROMPT_KEYS, "text").join(agg, PROMPT_KEYS, "left")
            .select(*PROMPT_KEYS, "text", F.size(ws_tokens("text")).cast("bigint").alias("n_words"),
                    longest.cast("bigint").alias("longest"),
                    F.coalesce(rump_hit, F.lit(False)).alias("rump"),
                    (longest > lb).alias("flagged")))
