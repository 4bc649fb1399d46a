"""Mixing sources to target weights by Pfair scheduling.

Documents of one source are put in a fixed pseudo-random order and cut into
blocks. Were slots divisible, all sources that still have blocks would run at
once, each at its weight over theirs; block k of a source would run from virtual
time ``k / w`` to ``(k + 1) / w``, and at virtual time V the blocks of sources
that are through, plus V times the weights of the others, would be out. Real
slots are not: block k is released at the slot (rounded down) in which it would
start and due when (rounded up) it would end; in each slot the released block
with the earliest deadline goes out. So every block runs inside its window, and
at any slot a source is less than one block off its share. Weights are taken as
the exact fractions that they are; a source that has run out leaves its
share to the others.

Releases and deadlines are columns of a table with one row per block. Slots are
dealt in one pass over that table in order of release, which holds the released
blocks only (one of each source, mostly), so any number of sources will do; it is one task, as a slot depends on
the slots before. The documents themselves, and ranks within a source, are
counted over hash-salted parts of bounded size.

Defined results: a null source is a source of its own; sources without a
weight get ``default_weight`` (0 is refused, no row is dropped); ties in id go
by the hash of the text, rows alike in both are interchangeable; an empty table
gives an empty result; extra columns are carried along whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import broadcast_if, scratch_table

BLOCK_DOCS = 32
PERIOD = 1000
#: Mean rows of one salted part of a source.
PART_ROWS = 2000
BROADCAST_PARTS = 100_000


def parts_of(weights: dict[str, float], period: int) -> dict[str, int]:
    """Integer parts (at least 1 each) of ``period`` by largest remainder."""
    total = math.fsum(weights.values())
    spare = period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    parts = {s: 1 + math.floor(x) for s, x in exact.items()}
    by_rest = sorted(weights, key=lambda s: (math.floor(exact[s]) - exact[s], s))
    for s in by_rest[:period - sum(parts.values())]:
        parts[s] += 1
    return parts


def one_period(parts: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period, earliest deadline first."""
    period = sum(parts.values())
    releases: list[list[str]] = [[] for _ in range(period)]
    for s, a in parts.items():
        for k in range(a):
            releases[k * period // a].append(s)
    slots: dict[str, list[int]] = {s: [] for s in parts}
    done = dict.fromkeys(parts, 0)
    waiting: list[tuple[int, str]] = []
    for t in range(period):
        for s in releases[t]:
            due = -(-(done[s] + 1) * period // parts[s])
            heapq.heappush(waiting, (due, s))
        _, s = heapq.heappop(waiting)
        slots[s].append(t)
        done[s] += 1
    return slots


def plan_phases(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> dict[str, list[tuple]]:
    """A periodic schedule with rounded weights, for few sources (``interleave`` deals by exact ones).
    Per source its phases: (first block, slot the phase starts at, period, slots of one period)."""
    left, given, start = dict(blocks), dict.fromkeys(blocks, 0), 0
    plan: dict[str, list[tuple]] = {s: [] for s in blocks}
    while left:
        parts = parts_of({s: weights[s] for s in left}, max(period, 4 * len(left)))
        size = sum(parts.values())
        slots = one_period(parts)
        last = {s: (n - 1) // parts[s] * size + slots[s][(n - 1) % parts[s]] for s, n in left.items()}
        length = min(last.values()) + 1
        for s in list(left):
            plan[s].append((given[s], start, size, slots[s]))
            out = length // size * parts[s] + sum(x < length % size for x in slots[s])
            given[s] += out
            left[s] -= out
            if not left[s]:
                del left[s]
        start += length
    return plan


def deal_slots(events: Iterable[tuple], total: Fraction) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) in order of slots.

    ``events`` are (source, block, blocks of the source, weight) in order of
    ``block / weight``; one with block = blocks says that the source is through.
    ``total`` is the sum of all weights.
    """
    through, slot = 0, 0
    waiting: list[tuple[float, str, int]] = []

    def deal() -> tuple[str, int, int]:
        nonlocal slot
        _, s, k = heapq.heappop(waiting)
        slot += 1
        return s, k, slot - 1

    for s, k, n, weight in events:
        up, down = weight.as_integer_ratio()
        if k == n:
            through, total = through + n, total - Fraction(up, down)
            continue
        release = through + k * total.numerator * down // (total.denominator * up)
        while slot < release and waiting:
            yield deal()
        heapq.heappush(waiting, ((k + 1) / weight, s, k))
    while waiting:
        yield deal()


def total_weight(sources: DataFrame) -> Fraction:
    """The exact sum of the column ``w``; one row per partition comes to the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((Fraction(w) for batch in batches for w in batch.column("w").to_pylist()), Fraction(0))
        yield pa.RecordBatch.from_pydict({"up": [str(total.numerator)], "down": [str(total.denominator)]})

    parts = sources.select("w").mapInArrow(add, "up string, down string").collect()
    return sum((Fraction(int(r["up"]), int(r["down"])) for r in parts), Fraction(0))


def block_slots(parts: DataFrame, sources: DataFrame, block_docs: int) -> DataFrame:
    """``s``, ``block``, ``slot`` of all blocks. ``parts``: ``before`` and ``n`` rows
    of the parts of each source ``s``; ``sources``: weight ``w`` and number of ``blocks``."""
    total = total_weight(sources)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches
                for r in zip(*(batch.column(c).to_pylist() for c in ("s", "k", "blocks", "w")), strict=True))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=["s", "block", "slot"])

        for dealt in deal_slots(rows, total):
            out.append(dealt)
            if len(out) == 10_000:
                yield flush()
        yield flush()

    def first(rows: str) -> str:  # the first block that starts at this row or later
        return f"cast(ceil(({rows}) / {block_docs}) as long)"

    own = parts.select("s", F.explode(F.expr(
        f"case when {first('before')} < {first('before + n')} "
        f"then sequence({first('before')}, {first('before + n')} - 1) end")).alias("k"))
    events = own.join(sources, "s").select("s", "k", "blocks", "w").unionByName(
        sources.select("s", F.col("blocks").alias("k"), "blocks", "w"))
    ordered = events.withColumn("v", F.col("k") / F.col("w")).repartition(1).sortWithinPartitions("v", "s", "k").drop("v")
    return scratch_table(ordered.mapInArrow(deal, "s string, block long, slot long"), "mix-slots")


def interleave(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0,
               source: str = "source", doc_id: str = "doc_id", text: str = "text",
               block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """Rows of ``docs`` as struct ``row`` with ``block`` (within the source),
    ``slot`` and ``position`` (0-based place in the whole mix; unique).

    ``weights`` maps source names to positive weights (a null source is named
    ``""``, others ``"=" + name``); None: square root of the document counts.
    ``period`` has no bearing any more, as weights are exact.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    sources = docs.groupBy(name.alias("s")).agg(F.count("*").alias("docs"))
    if weights is None:
        sources = sources.withColumn("w", F.sqrt(F.col("docs").cast("double")))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, w double")
        sources = sources.join(given, "s", "left").withColumn("w", F.coalesce("w", F.lit(float(default_weight))))
    sources = scratch_table(sources.withColumn("blocks", F.ceil(F.col("docs") / block_docs)), "mix-sources")
    good = (F.col("w") > 0) & (F.col("w") < float("inf"))
    if not sources.where(~good).isEmpty():
        raise ValueError("every source needs a weight above 0")

    salts = max(1, -(-(sources.agg(F.max("docs")).first()[0] or 0) // PART_ROWS))
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), name.alias("s"),
        F.xxhash64(F.lit("order"), F.col(doc_id)).alias("h"), F.xxhash64(text).alias("t")
    ).withColumn("salt", F.pmod("h", F.lit(salts)))
    per_part = keyed.groupBy("s", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("s").orderBy("salt")) - F.col("n")
    parts = scratch_table(per_part.select("s", "salt", "n", before.alias("before")), "mix-offsets")
    slots = block_slots(parts, sources, block_docs)
    rank = F.row_number().over(W.partitionBy("s", "salt").orderBy("h", "t", f"row.{doc_id}")) - 1
    ranked = (keyed.withColumn("in_part", rank).join(broadcast_if(parts.drop("n"), BROADCAST_PARTS), ["s", "salt"])
              .withColumn("r", F.col("before") + F.col("in_part")))
    placed = ranked.select("row", "s", "r", F.floor(F.col("r") / block_docs).alias("block"))
    slotted = placed.join(broadcast_if(slots, BROADCAST_PARTS), ["s", "block"])
    # Short last blocks leave gaps in slot * block_docs + place; order is what counts.
    return slotted.select("row", "block", "slot",
                          (F.col("slot") * block_docs + F.pmod("r", F.lit(block_docs))).alias("position"))


def mix_report(docs: DataFrame) -> DataFrame:
    return interleave(docs.select("doc_id", "source", "text")).select(
        "row.doc_id", "row.source", "block", "slot", "position")


def mix(docs: DataFrame) -> DataFrame:
    """All documents with the place each has in the mix."""
    out = interleave(docs)
    taken = {c.lower() for c in docs.columns}
    own = {c: c if c not in taken else f"mix_{c}" for c in ("slot", "position")}
    return out.select("row.*", *[F.col(c).alias(n) for c, n in own.items()])
