"""Natural-prompt regex scan (RGX1-RGX5, FLT9, Q13).

Counts, per corpus line, the non-overlapping places where a word and one of
its transformed forms stand next to each other (either order), separated by
non-word characters and bounded by non-word characters or the line edges.

A match holds the word runs of both forms side by side as whole runs, so lines
and pairs are first equi-joined on the first two runs (one, where there is one
only). A line's own pattern is then the alternation of just the pairs found in
it, in list order; the others could not match. This holds for lists of any
size, all transforms share one scan, and the pairs stay a DataFrame. Pairs
without any word character have no run to join on and meet every line.

Before the join, the places of a line are tested against a bitmap of the pairs'
hashed runs, built by Spark's bitmap aggregates and sent as a constant, so that
only places where a pair may stand leave the row. The line goes with them:
there is no second scan to fetch it.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprobe.functions.text import let, unnest
from corpusprobe.operators.occurrences import BROADCAST_BYTES, query_bytes
from corpusprobe.session import ensure_checkpoint_dir

# Python's \W for str patterns, and UNIX_LINES so that '$' means
# end of line or before a final '\n', as in Python.
NON_WORD = "[^\\p{L}\\p{N}_]"
FLAGS = "(?d)"

BITMAP_BITS = 32768   # of one of Spark's bitmaps
MAX_BITMAPS = 64      # sent with the scan: 256 KB

Pairs = DataFrame | dict[str, list[tuple[str, str]]]


def quote(word: str) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(F.col(word), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def unitary_regex(w1: str, w2: str) -> Column:
    """RGX1: the columns w1 and w2 adjacent, in either order."""
    # Fixed form of the pattern.
    start, gap, end = F.lit(f"(^|{NON_WORD}+)"), F.lit(f"{NON_WORD}+"), F.lit(f"($|{NON_WORD}+)")
    a, b = quote(w1), quote(w2)
    return F.concat(start, a, gap, b, end, F.lit("|"), start, b, gap, a, end)


def regex_from_pairs(regexes: Column) -> Column:
    """RGX2: alternation of an array of unitary patterns."""
    return F.concat(F.lit(FLAGS), F.array_join(regexes, "|"))


def factored_regex(cores: Column) -> Column:
    """RGX2 of pairs whose words all begin with a word character, given their :func:`pair_core`.

    Then a match can start in one way only at each place (at the line's start, or
    with the whole run of non-word characters before the word), so the start that all
    alternatives share is tried once a place, not once an alternative."""
    return F.concat(F.lit(f"{FLAGS}(?:^|{NON_WORD}+)(?:"), F.array_join(cores, "|"), F.lit(f")(?:$|{NON_WORD}+)"))


def pair_core(w1: str, w2: str) -> Column:
    """The columns w1 and w2 side by side, in either order, without what stands around them."""
    a, b, gap = quote(w1), quote(w2), F.lit(f"{NON_WORD}+")
    return F.concat(a, gap, b, F.lit("|"), b, gap, a)


def word_pairs(words: DataFrame, transform_fn, n_outputs: int = 5) -> DataFrame:
    """RGX5: ``(word, transformed)``; palindromes are kept."""
    return words.select("word", F.explode(F.array_distinct(transform_fn(F.col("word"), n_outputs)))
                        .alias("transformed"))


def pair_table(lines: DataFrame, pairs: Pairs) -> DataFrame:
    """``(transform, idx, word, transformed)``; lists keep their order as ``idx``."""
    if isinstance(pairs, DataFrame):
        return pairs.select("transform", "idx", "word", "transformed")
    rows = [(name, i, w, t) for name, listed in pairs.items() for i, (w, t) in enumerate(listed)]
    return lines.sparkSession.createDataFrame(
        rows, "transform string, idx bigint, word string, transformed string")


def _word_runs(text) -> Column:
    return F.filter(F.split(text, NON_WORD + "+"), lambda x: x != F.lit(""))


def _keyed_patterns(pairs: DataFrame) -> DataFrame:
    """``(transform, idx, regex, core, n, key, hash)``: per order of a pair its first runs; ``core`` is null where a word
    begins with a non-word character."""
    def first_runs(a: str, b: str) -> Column:
        return F.slice(F.concat(_word_runs(F.col(a)), _word_runs(F.col(b))), 1, 2)

    orders = F.array_distinct(F.array(first_runs("word", "transformed"), first_runs("transformed", "word")))
    plain = F.col("word").rlike(f"^(?!{NON_WORD}).") & F.col("transformed").rlike(f"^(?!{NON_WORD}).")
    return (pairs.select("transform", "idx", unitary_regex("word", "transformed").alias("regex"),
                         F.when(plain, pair_core("word", "transformed")).alias("core"), F.explode(orders).alias("runs"))
            .select("transform", "idx", "regex", "core", F.size("runs").alias("n"), F.array_join("runs", " ").alias("key"),
                    F.xxhash64(F.get("runs", F.lit(0)), F.get("runs", F.lit(1))).alias("hash")))


def _bitmap(patterns: DataFrame, n_keys: int) -> np.ndarray:
    """The words of a bitmap of the patterns' hashes, at least eight bits a key up to ``MAX_BITMAPS`` bitmaps."""
    bitmaps = max(1, min(MAX_BITMAPS, -(-8 * n_keys // BITMAP_BITS)))
    bit = F.pmod("hash", F.lit(BITMAP_BITS * bitmaps))
    rows = (patterns.groupBy(F.floor(bit / BITMAP_BITS).cast("int").alias("at"))
            .agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(BITMAP_BITS))).alias("bits")).collect())
    words = np.zeros(bitmaps * BITMAP_BITS // 64, dtype=np.int64)
    for r in rows:  # a bitmap counts from the lowest bit of its first byte
        words.reshape(bitmaps, -1)[r["at"]] = np.frombuffer(bytes(r["bits"]), dtype="<i8")
    return words


def _line_keys(runs: Column, sizes: list[int], words: np.ndarray) -> Column:
    """The keys of a line, for the run counts in use, that the bitmap holds."""
    listed = F.from_json(F.lit(json.dumps(words.tolist())), "array<bigint>")  # folded to a constant

    def key(n: int, text: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), text.alias("key"))

    def held(a: Column, b: Column) -> Column:
        bit = F.pmod(F.xxhash64(a, b), F.lit(len(words) * 64))
        word = F.get(listed, F.shiftright(bit, 6).cast("int"))
        return F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1

    none = F.lit(None).cast("string")
    follower = lambda i: F.get(runs, i + 1)
    places = F.sequence(F.lit(0), F.size(runs) - 2)
    kinds = {
        0: F.array(key(0, F.lit(""))),
        1: F.transform(F.filter(runs, lambda x: held(x, none)), lambda x: key(1, x)),
        2: F.when(F.size(runs) >= 2, F.transform(F.filter(places, lambda i: held(F.get(runs, i), follower(i))),
                                                 lambda i: key(2, F.concat(F.get(runs, i), F.lit(" "), follower(i)))))
            .otherwise(F.array().cast("array<struct<n:int,key:string>>")),
    }
    return F.array_distinct(F.concat(*[kinds[n] for n in sizes]))


def _matches(lines: DataFrame, pairs: Pairs, broadcast_bytes: int) -> tuple[DataFrame, list[str]]:
    """``(doc_id, line_no, transform, n)`` with n > 0, and the transforms' names."""
    lines = lines.select("doc_id", "line_no", "line")
    ensure_checkpoint_dir(lines.sparkSession)
    # The list may be costly to derive, and is read three times.
    patterns = _keyed_patterns(pair_table(lines, pairs)).checkpoint()
    # One small action: size, run counts (three at most) and the transforms' names.
    facts = patterns.agg(F.sum(query_bytes(patterns)).alias("bytes"), F.collect_set("n").alias("sizes"),
                         F.collect_set("transform").alias("names"), F.count(F.lit(1)).alias("keys")).first()
    if not facts["sizes"]:
        return lines.where(F.lit(False)).select(
            "doc_id", "line_no", F.lit("").alias("transform"), F.lit(0).cast("bigint").alias("n")), []
    words = _bitmap(patterns, facts["keys"])
    patterns = patterns.drop("hash")
    if facts["bytes"] <= broadcast_bytes:
        patterns = F.broadcast(patterns)
    keys = let(_word_runs(F.col("line")), lambda r: _line_keys(r, sorted(facts["sizes"]), words))
    found = (unnest(lines, keys, "doc_id", "line_no", "line", name="k")
             .select("doc_id", "line_no", "line", "k.n", "k.key").join(patterns, ["n", "key"])
             .groupBy("doc_id", "line_no", "line", "transform")
             .agg(F.array_sort(F.collect_set(F.struct("idx", "regex", "core"))).alias("r"))
             .withColumn("pattern", F.when(F.forall("r", lambda x: x["core"].isNotNull()), factored_regex(F.transform("r", lambda x: x["core"])))
                         .otherwise(regex_from_pairs(F.transform("r", lambda x: x["regex"])))))
    # Unnested, as a filter on a projected count would count twice.
    count = F.array(F.regexp_count("line", F.col("pattern")).cast("bigint"))
    counted = unnest(found, count, "doc_id", "line_no", "transform", name="n")
    return counted.where(F.col("n") > 0), sorted(facts["names"])


def natural_prompt_counts(lines: DataFrame, pairs: Pairs, keep_zeros: bool = False,
                          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """RGX3/RGX4: ``(doc_id, line_no, transform, n)`` with n = non-overlapping matches.

    ``pairs`` is ``(transform, idx, word, transformed)``, or a list of pairs per
    transform. ``keep_zeros`` adds all other lines for each transform.
    """
    counted, names = _matches(lines, pairs, broadcast_bytes)
    if not keep_zeros or not names:
        return counted
    every = lines.select("doc_id", "line_no", F.explode(F.array(*map(F.lit, names))).alias("transform"))
    return (every.join(counted, ["doc_id", "line_no", "transform"], "left")
            .select("doc_id", "line_no", "transform", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def natural_prompt_docs(lines: DataFrame, pairs: Pairs, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """FLT9 + AGG9 (Q13): per transform, lines scanned, lines with a match and
    the total number of matches."""
    counted, names = _matches(lines, pairs, broadcast_bytes)
    none = F.lit(0).cast("bigint")
    scanned = (lines.agg(F.count(F.lit(1)).alias("lines"))
               .select(F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("transform"), "lines",
                       none.alias("hit"), none.alias("n")))
    hits = counted.groupBy("transform").agg(F.count(F.lit(1)).alias("hit"), F.sum("n").alias("n"))
    return (scanned.unionByName(hits.withColumn("lines", none)).groupBy("transform")
            .agg(F.sum("lines").alias("lines"), F.sum("hit").alias("matching_lines"), F.sum("n").alias("matches")))
