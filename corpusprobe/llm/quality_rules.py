"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Every document gets integer measures; per language and source a mergeable
quantile sketch of each measure is built, and a document goes when a measure
lies outside the fence ``q25 - reach .. q75 + reach`` of its own group, with
``reach = max(8 * (q75 - q25), slack)``.

The sketch is a histogram over values cut to six significant bits (relative
error below 1/32, integer arithmetic). Two sketches merge by adding counts, so
partial sketches are built map-side, and the sketches of a language and of the
whole corpus are sums of the finer ones. A group of fewer than ``MIN_GROUP``
documents takes its language's fences, a small language those of the corpus.

Defined results: null and empty texts have no words and fail the base rules;
a null language or source is a group of its own; repeated rows count each
time and are judged alike; an empty table gives an empty result; extra columns
are carried along whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE_CHARS, broadcast_if, scratch_table, text_or_empty

#: The symbols of the base measure, the repeat window, the base limits.
SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 8  # 2 * 2 * 2, see measure()
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

MIN_GROUP = 100
FENCE = 8
#: A thresholds table of more rows (language, source) is joined, not broadcast.
BROADCAST_GROUPS = 50_000

#: measure -> (slack below, slack above); None: no fence on that side. Shares
#: are per mille, the word length is in thousandths of a character.
RULES: dict[str, tuple[int | None, int | None]] = {
    "symbol_share": (None, 60),
    "upper_share": (None, 300),
    "word_length": (1500, 4000),
    "repeat_share": (None, 300),
    "dup_line_share": (None, 600),
}


def _joined(ids: str, step: int) -> Column:
    """Hashes of each element with the one ``step`` further on; null if too few."""
    n = F.size(ids) - step
    return F.when(n > 0, F.zip_with(F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(step + 1), n),
                                    lambda x, y: F.xxhash64(x, y)))


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` as one struct ``row``, with the measures."""
    full = text_or_empty(text)
    base = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("row"), full.alias("full"),
        F.filter(F.split(full, f"[{SPACE_CHARS}]+"), lambda x: x != "").alias("words"),
        F.filter(F.split(full, "\n"), lambda x: x.rlike(f"[^{SPACE_CHARS}]")).alias("lines"))
    n = F.size("words")
    hashed = base.select(
        "row", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("full", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("full", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("ids"))
    k = REPEAT_WORDS
    rest = [c for c in hashed.columns if c != "ids"]
    wins = hashed.withColumnRenamed("ids", "wins")
    for step in (1, 2, 4):  # hashes of 2, 4, then 8 words
        wins = wins.select(*rest, _joined("wins", step).alias("wins"))
    # Only a text with some repeated window pays for the sort.
    order = F.when(F.size(F.array_distinct("wins")) < F.size("wins"), F.sort_array(
        F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    ordered = wins.select(*rest, order.alias("ordered"))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x["h"] == y["h"], F.lit(False))

    twice = F.filter("ordered", lambda x, i: same(x, F.get("ordered", i + 1))
                     | ((i > 0) & same(x, F.get("ordered", i - 1))))
    starts = ordered.select(*rest, F.sort_array(F.transform(twice, lambda x: x["at"])).alias("starts"))
    covered = F.aggregate(
        F.transform("starts", lambda p, i: F.least(F.lit(k), F.coalesce(F.get("starts", i + 1) - p, F.lit(k)))),
        F.lit(0), lambda a, x: a + x)
    counts = starts.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))

    def share(a: str, b: str, scale: int = 1000) -> Column:
        return F.coalesce(F.expr(f"({a} * {scale}) div nullif({b}, 0)"), F.lit(0).cast("long"))

    return counts.withColumns({
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "word_length": share("word_chars", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })


def _key(name: str) -> Column:
    """A group key without nulls: '' for null, '=' and the value otherwise."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def sketches(measured: DataFrame, lang: str = "row.lang", source: str = "row.source") -> DataFrame:
    """One row per language, source, measure and cell: the mergeable sketch.

    Documents that the base rules reject don't shape the fences.
    """
    cell = "if(v < 64, v, v - v % shiftleft(1L, length(bin(v)) - 6))"
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in RULES]))
    return (measured.where(~F.col("base_failed"))
            .select(_key(lang).alias("lang"), _key(source).alias("source"), pairs.alias("p"))
            .select("lang", "source", "p.measure", F.col("p.v").alias("v"))
            .groupBy("lang", "source", "measure", F.expr(cell).alias("cell")).agg(F.count("*").alias("n")))


def _quartiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """q25 and q75 of every measure per group, one row per group."""
    merged = sketch.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "measure")
    cum = merged.withColumns({"below": F.sum("n").over(w.orderBy("cell")), "all": F.sum("n").over(w)})
    cols = [F.max("all").alias(f"{tag}_n")]
    for m in RULES:
        for q in (1, 3):
            hit = (F.col("measure") == m) & (4 * F.col("below") >= q * F.col("all"))
            cols.append(F.min(F.when(hit, F.col("cell"))).alias(f"{tag}_{m}_{q}"))
    return cum.groupBy(*keys).agg(*cols)


def thresholds(sketch: DataFrame) -> DataFrame:
    """Per language and source the fences ``low_<measure>``, ``high_<measure>``."""
    own = _quartiles(sketch, ["lang", "source"], "own")
    by_lang = _quartiles(sketch, ["lang"], "lang")
    corpus = _quartiles(sketch.withColumn("one", F.lit(1)), ["one"], "corpus")
    both = own.join(by_lang, "lang").withColumn("one", F.lit(1)).join(corpus, "one")

    def pick(name: str) -> Column:
        return (F.when(F.col("own_n") >= MIN_GROUP, F.col(f"own_{name}"))
                .when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{name}")).otherwise(F.col(f"corpus_{name}")))

    cols = [F.col("lang"), F.col("source")]
    for m, (below, above) in RULES.items():
        q25, q75 = pick(f"{m}_1"), pick(f"{m}_3")
        cols.append((q25 - F.greatest(FENCE * (q75 - q25), F.lit(below).cast("long"))
                     if below is not None else F.lit(None).cast("long")).alias(f"low_{m}"))
        cols.append((q75 + F.greatest(FENCE * (q75 - q25), F.lit(above).cast("long"))
                     if above is not None else F.lit(None).cast("long")).alias(f"high_{m}"))
    return both.select(*cols)


def judge(measured: DataFrame, fences: DataFrame, lang: str = "row.lang", source: str = "row.source") -> DataFrame:
    """``measured`` with ``kept``; a group without fences is all base failures."""
    outside = reduce(lambda a, b: a | b, [
        F.coalesce(F.col(m) < F.col(f"low_{m}"), F.lit(False)) | F.coalesce(F.col(m) > F.col(f"high_{m}"), F.lit(False))
        for m in RULES])
    named = fences.withColumnsRenamed({"lang": "fence_lang", "source": "fence_source"})
    joined = measured.join(named, (_key(lang) == F.col("fence_lang")) & (_key(source) == F.col("fence_source")), "left")
    return joined.select(*measured.columns, (~F.col("base_failed") & ~outside).alias("kept"))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Measures and verdicts of all documents; ``keep`` lists the columns that
    the result's struct ``row`` carries (``lang`` and ``source`` among them).

    The measured table is stored once: it feeds the sketches and the verdicts.
    """
    measured = scratch_table(measure(docs, keep), "quality-measures")
    fences = scratch_table(thresholds(sketches(measured)), "quality-fences")
    return judge(measured, broadcast_if(fences, BROADCAST_GROUPS))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: id, base measures, base verdict and verdict."""
    return judged(docs, ["doc_id", "lang", "source"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judged(docs, docs.columns).where("kept").select("row.*")
