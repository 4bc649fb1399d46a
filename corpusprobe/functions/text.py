"""Column expressions for tokens, n-grams and tiles.

All of them are native Catalyst expressions (higher-order array functions,
regex split), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the code points Python's str.split() treats as whitespace,
# written as a Java regex class (\p{Z} = space, line and paragraph separators).
WS_CLASS = "[\\t-\\r\\x1c-\\x1f\\x85\\p{Z}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Catalyst inlines a projected expression into a lambda that references it,
    which re-evaluates it per array element (a regex split per n-gram). Binding
    it through a one-element ``transform`` evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(_c(value)), fn), 1)


def unnest(df: DataFrame, array, *columns, name: str, at: str | None = None) -> DataFrame:
    """``columns`` with a row for each element of ``array`` as ``name`` (its place as ``at``), none for empty arrays.

    A plain explode makes the optimizer test ``size(array) > 0`` below it, which
    evaluates the array (splits a text, builds its n-grams) a second time. An
    outer explode has no such test; its one row for an empty array goes after.
    The array must not hold nulls."""
    array = _c(array)
    spread = F.explode_outer(array).alias(name) if at is None else F.posexplode_outer(array).alias(at, name)
    return df.select(*columns, spread).where(F.col(name).isNotNull())


def ws_tokens(text) -> Column:
    """``text.split()``: split on any run of Unicode whitespace, no empties."""
    return F.filter(F.split(_c(text), WS_CLASS + "+"), lambda x: x != F.lit(""))


def space_pieces(text) -> Column:
    """Split on the literal space only, keeping empty pieces (``str.split(' ')``)."""
    return F.split(_c(text), " ", -1)


def power_log(x) -> Column:
    """Next power of two >= x, computed as ``2 ** ceil(ln x / ln 2)``.

    The same floating-point formula as a log with base 2 in Python; x <= 0 gives
    null.
    """
    x = _c(x)
    e = F.ceil(F.log(2.0, x.cast("double")))
    return F.when(x > 0, F.pow(F.lit(2.0), e).cast("bigint"))


def ngram_list(words, n: int) -> Column:
    """All n-grams of a word array in order, duplicates kept (each an array)."""
    return let(words, lambda w: F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n)),
    ).otherwise(F.array().cast("array<array<string>>")))


def ngram_strings(words, n: int) -> Column:
    """n-grams joined by one space (the form stored in an n-gram index)."""
    return F.transform(ngram_list(words, n), lambda g: F.array_join(g, " "))


def ngram_set(words, n: int) -> Column:
    """Distinct n-grams of a word array (first occurrence order)."""
    return F.array_distinct(ngram_strings(words, n))


def fixed_tile_starts(n_words, length: int) -> Column:
    """Start offsets 0, L, 2L, ... < n (empty for n = 0)."""
    n = _c(n_words)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(length))).otherwise(
        F.array().cast("array<int>"))


def fixed_tile(words, start, length: int) -> Column:
    """Tile of ``length`` words at ``start``; the last tile backs off so that it
    holds the last ``length`` words of the prompt."""
    s = _c(start)

    def tile(w):
        n = F.size(w)
        last = F.slice(w, F.greatest(n - length, F.lit(0)) + 1, F.lit(length))
        inner = F.slice(w, s + 1, F.lit(length))
        return F.array_join(F.when(s + length >= n, last).otherwise(inner), " ")
    return let(words, tile)


def halving_scales(n, lower_bound: int) -> Column:
    """Scales power_log(n), power_log(n)/2, ... that are >= lower_bound."""
    top = power_log(n)
    lb_exp = 0
    while (1 << lb_exp) < lower_bound:
        lb_exp += 1
    top_exp = F.ceil(F.log(2.0, _c(n).cast("double"))).cast("int")
    return F.when(
        (_c(n) > 0) & (top >= lower_bound),
        F.transform(F.sequence(top_exp, F.lit(lb_exp), F.lit(-1)),
                    lambda e: F.pow(F.lit(2.0), e).cast("bigint")),
    ).otherwise(F.array().cast("array<bigint>"))
