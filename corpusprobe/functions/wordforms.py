"""Word transformations (TRF1-TRF7) as native column expressions.

Each transform maps a word column to ``array<string>`` (a set: distinct
values). The reference draws random shuffles and separators; here every draw
is keyed by ``md5(word:k:pos)``, so results are reproducible on any
partitioning and equal in any engine that has md5.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusprobe.functions.text import let

# The separators the insertion transform puts between letters.
INSERTION_CHARS = [",", ".", "!", "/", "\\", ":", ";", " "]
HEX = "0123456789abcdef"


def _draw(word: Column, k, pos) -> Column:
    return F.md5(F.concat_ws(":", word, k.cast("string"), pos.cast("string")))


def shuffle_chars(word: Column, s: Column, k) -> Column:
    """Deterministic permutation of string ``s``: characters sorted by md5."""
    def go(x):
        keys = F.transform(F.sequence(F.lit(1), F.length(x)),
                           lambda p: F.concat(_draw(word, k, p), F.substring(x, p, 1)))
        return F.when(F.length(x) > 0,
                      F.array_join(F.transform(F.array_sort(keys), lambda y: F.substring(y, 33, 1)), "")
                      ).otherwise(F.lit(""))
    return let(s, go)


def build_reverse(word, n_outputs: int = 5) -> Column:
    return F.array(F.reverse(word))


def _anagram(word: Column, keep: int, n_outputs: int) -> Column:
    n = F.length(word)
    mid = F.substring(word, keep + 1, F.greatest(n - 2 * keep, F.lit(0)))
    head = F.substring(word, 1, keep)
    tail = F.right(word, F.lit(keep))
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(n_outputs)),
        lambda k: F.concat(head, shuffle_chars(word, mid, k), tail)))


def build_anagram_hard(word, n_outputs: int = 5) -> Column:
    """First and last letter kept, the middle shuffled."""
    return _anagram(word, 1, n_outputs)


def build_anagram_easy(word, n_outputs: int = 5) -> Column:
    """First two and last two letters kept, the middle shuffled."""
    return _anagram(word, 2, n_outputs)


def build_cycles(word, n_outputs: int = 5) -> Column:
    """All rotations, the word itself included."""
    n = F.length(word)
    return F.when(n > 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.concat(F.substring(word, i + 1, 1 << 30), F.substring(word, 1, i)))
    )).otherwise(F.array(F.lit("")))


def build_insertion(word, n_outputs: int = 5, chars: list[str] | None = None) -> Column:
    """One drawn separator between consecutive letters, none after the last."""
    seps = F.array(*[F.lit(c) for c in (chars or INSERTION_CHARS)])
    n_seps = len(chars or INSERTION_CHARS)
    n = F.length(word)

    def one(k):
        def piece(p):
            idx = F.pmod(F.instr(F.lit(HEX), F.substring(_draw(word, k, p), 1, 1)) - 1, F.lit(n_seps))
            return F.concat(F.substring(word, p, 1),
                            F.when(p < n, F.element_at(seps, idx + 1)).otherwise(F.lit("")))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), piece), "")
                      ).otherwise(F.lit(""))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n_outputs)), one))


def combine(transformed: Column, word: Column) -> Column:
    """TRF7: the eight strings pairing a word with one of its transforms."""
    def pair(og, t):
        return [F.concat(og, F.lit(", "), t), F.concat(og, F.lit(" "), t),
                F.concat(og, F.lit(" = "), t), F.concat(og, F.lit("="), t)]
    return F.array(*pair(word, transformed), *pair(transformed, word))


# UDF1: the named registry, in the reference's order. A user may add any
# ``fn(word_col, n_outputs) -> Column[array<string>]`` (a udf/pandas_udf too).
TRANSFORMS: "OrderedDict[str, Callable[..., Column]]" = OrderedDict([
    ("reverse", build_reverse),
    ("anagram_hard", build_anagram_hard),
    ("anagram_easy", build_anagram_easy),
    ("insertion", build_insertion),
    ("cycles", build_cycles),
])


def select_transforms(flags: dict[str, bool] | list[str] | None = None) -> "OrderedDict[str, Callable]":
    """FLT8: transforms chosen by flag, registry order kept."""
    if flags is None:
        return OrderedDict(TRANSFORMS)
    chosen = set(k for k, v in flags.items() if v) if isinstance(flags, dict) else set(flags)
    unknown = chosen - set(TRANSFORMS)
    if unknown:
        raise KeyError(f"unknown transforms: {sorted(unknown)}")
    return OrderedDict((k, v) for k, v in TRANSFORMS.items() if k in chosen)
