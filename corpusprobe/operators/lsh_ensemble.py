"""LSH Ensemble: containment search over a sorted prefix index (MH1-MH3).

The question is which indexed sets X hold at least a fraction ``t`` of a query
set Q. MinHash estimates Jaccard similarity, which for containment depends on
the size of X, so the sets are parted by size and each part is searched at the
Jaccard similarity that ``t`` implies for its largest set.

* The parts (:func:`size_bounds`) minimise the expected number of false
  candidates: a set of size x in a part of upper size u is searched as if it
  had size u, which costs about ``(u - x) / u``. A dynamic program over the
  histogram of sizes finds the best cuts; bounds are exact sizes.
* The index (:func:`lsh_index`) holds one row for each set and tree. The row's
  ``path`` are the signature values from the tree's own one onwards, written
  as fixed-width hex, so that comparing the first r values is comparing a
  prefix: rows sorted by (tree, path) answer any r by a range.
* A probe (:func:`containment_lsh`) chooses, for each part and power-of-two
  query size, the longest prefix r whose ``NUM_PERM // r`` trees reach
  ``RECALL`` at the implied similarity, and as few trees as that takes. Index
  rows meet the queries on the first value of the path (an equi-join, against a
  broadcast of the queries where they are small) and on the range of the
  prefix. Candidates are confirmed on the full sets: precision is 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corpusprobe.functions.text import let, ngram_set, unnest, ws_tokens
from corpusprobe.operators.minhash import (
    BROADCAST_BYTES, NUM_PERM, PRIME, SEED, broadcast_if_small, permutations, shingle_hash, verify_containment)
from corpusprobe.session import ensure_checkpoint_dir

NUM_PART = 32
#: Longest prefix, in signature values; hex digits of a value.
DEPTH, DIGITS = 8, 8
#: Share of sets at the implied similarity that the chosen trees find, where NUM_PERM values allow it.
RECALL = 0.98
#: Sizes below this have a histogram cell each; above, 32 cells for each power of two.
EXACT_SIZES = 64
#: Shingle hashes whose minima are taken at once (they stay in a core's cache).
CHUNK = 1 << 16
#: Texts whose n-grams are hashed at once.
TEXTS = 256


# ------------------------------------------------------------------ sets and signatures

@dataclass
class Sets:
    """Sets still to be built from a table: the columns of their unique key and of their distinct members
    (for word n-grams of a text, also its column and n)."""

    df: DataFrame
    key: Column
    shingles: Column
    text: Column | None = None
    n: int = 0

    def rows(self) -> DataFrame:
        """``(key, shingles)``."""
        return self.df.select(self.key.alias("key"), self.shingles.alias("shingles"))

    def members(self, keys: DataFrame | None = None) -> DataFrame:
        """``(key, shingle)``; with ``keys`` (column ``key``), only their sets are built."""
        df = self.df.withColumn("_key", self.key)
        if keys is not None:
            df = df.join(keys.withColumnRenamed("key", "_wanted"), F.col("_key") == F.col("_wanted"), "left_semi")
        return unnest(df, self.shingles, F.col("_key").alias("key"), name="shingle")


def text_sets(df: DataFrame, key_col: str, text_col: str = "text", n: int = 5) -> Sets:
    """The distinct word n-grams of each row's text."""
    return Sets(df, F.col(key_col), ngram_set(ws_tokens(text_col), n), F.col(text_col), n)


def set_rows(df: DataFrame, key_col: str, text_col: str = "text", n: int = 5) -> DataFrame:
    """``(key, shingles)`` of :func:`text_sets`."""
    return text_sets(df, key_col, text_col, n).rows()


def indexed_keys(df: DataFrame, key_col: str, text_col: str = "text", n: int = 5) -> DataFrame:
    """MH5: the keys with a non-empty shingle set, without building it."""
    return df.where(F.size(ws_tokens(text_col)) >= n).select(F.col(key_col).alias("key"))


def minima(flat: np.ndarray, starts: np.ndarray, perms: list[tuple[int, int]]) -> np.ndarray:
    """Per set (``flat[starts[i]:starts[i + 1]]``) the minima of ``(a h + b) mod PRIME`` of all (a, b).

    The prime is 2^31 - 1, so two rounds of adding the high to the low bits leave the remainder."""
    out = np.empty((len(starts), len(perms)), dtype=np.int64)
    for i, (a, b) in enumerate(perms):
        x = flat * a + b
        x = (x & PRIME) + (x >> 31)
        x = (x & PRIME) + (x >> 31)
        x[x == PRIME] = 0
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def text_hashes(text: str, n: int) -> np.ndarray:
    """The :func:`~corpusprobe.operators.minhash.shingle_hash` of each distinct word n-gram of a text."""
    words = text.split()
    if len(words) < n:
        return np.zeros(0, dtype=np.int64)
    raw = " ".join(words).encode()
    ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words]) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    grams = dict.fromkeys(raw[a:b] for a, b in zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist(), strict=True))
    digests = b"".join([md5(g, usedforsecurity=False).digest() for g in grams])
    return np.frombuffer(digests, dtype=">u4")[::4].astype(np.int64) % PRIME


def _row_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and hashes of sets that come as lists of hashes."""
    hashes = batch.column("h")
    return hashes.value_lengths().fill_null(0).to_numpy().astype(np.int64), hashes.flatten().to_numpy()


def set_signatures(rows: DataFrame | Sets, num_perm: int = NUM_PERM, seed: int = SEED) -> DataFrame:
    """MH1 over :func:`set_rows` or sets still to be built: ``(key, size, sig array<bigint>)`` of the non-empty sets, without a
    shuffle. n-grams of texts are cut and hashed in the tasks, text by text.

    The same values as :func:`~corpusprobe.operators.minhash.minhash_signatures`, which
    takes sets spread over many rows."""
    if isinstance(rows, Sets) and rows.text is not None:
        n, given = rows.n, rows.df.select(rows.key.alias("key"), rows.text.alias("text"))
    else:
        rows = rows.rows() if isinstance(rows, Sets) else rows
        n, given = 0, rows.select("key", F.transform("shingles", shingle_hash).alias("h"))
    perms = permutations(num_perm, seed)
    result = StructType([StructField("key", given.schema["key"].dataType), StructField("size", LongType()),
                         StructField("sig", ArrayType(LongType()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            if not n:
                yield batch, *_row_hashes(batch)
                continue
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = [text_hashes(t, n) if t is not None else np.zeros(0, np.int64) for t in part.column("text").to_pylist()]
                yield part, np.array([len(f) for f in found], dtype=np.int64), np.concatenate(found)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, flat in hashed(batches):
            ends = np.cumsum(sizes)
            full = np.flatnonzero(sizes)
            at = 0
            while at < len(full):
                first = ends[full[at]] - sizes[full[at]]
                upto = max(at + 1, int(np.searchsorted(ends[full], first + CHUNK, side="right")))
                some = full[at:upto]
                found = minima(flat[first:ends[some[-1]]], ends[some] - sizes[some] - first, perms)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(pa.array(some)), pa.array(sizes[some]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, num_perm, dtype=np.int32)),
                                             pa.array(found.ravel()))], names=["key", "size", "sig"])
                at = upto

    return given.mapInArrow(signatures, result)


# ------------------------------------------------------------------ parts by size

def size_histogram(sizes: DataFrame) -> DataFrame:
    """``(cell, n, total, top)``: sets, summed sizes and the largest size of each cell.

    There are at most ``EXACT_SIZES`` cells and 32 for each doubling of the largest size, whatever the number of sets."""
    width = F.expr("shiftleft(1L, length(bin(size)) - 6)")
    cell = F.when(F.col("size") < EXACT_SIZES, F.col("size")).otherwise(F.col("size") - F.col("size") % width)
    return sizes.groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("size").alias("top"))


def size_bounds(histogram: list[tuple[int, int, int]], num_part: int = NUM_PART) -> list[int]:
    """Upper sizes of at most ``num_part`` parts with the fewest expected false candidates.

    ``histogram``: (sets, summed sizes, largest size) by rising size. The cost of a part
    is the sum of (u - x) / u over its sets, in thousandths; among equally good cuts the
    ones further left count."""
    if not histogram:
        return []
    n, total, top = (np.array(x, dtype=np.int64) for x in zip(*histogram, strict=True))
    n, total = np.cumsum(n), np.cumsum(total)
    unit = 1000 if int(top[-1]) * int(n[-1]) < 2**52 else 1
    best = (top * n - total) * unit // top  # one part up to each cell
    cuts = []
    for _ in range(min(num_part, len(top)) - 1):
        now, cut = np.full(len(top), np.iinfo(np.int64).max), np.full(len(top), -1)
        for j in range(len(cuts) + 1, len(top)):
            i = np.arange(len(cuts), j)
            costs = best[i] + (top[j] * (n[j] - n[i]) - (total[j] - total[i])) * unit // top[j]
            k = int(costs.argmin())
            now[j], cut[j] = costs[k], i[k]
        best = now
        cuts.append(cut)
    ends = [len(top) - 1]
    for cut in reversed(cuts):
        ends.append(int(cut[ends[-1]]))
    return [int(top[j]) for j in reversed(ends)]


def partition_of(size, bounds: list[int]) -> Column:
    """The first part whose upper size holds ``size``."""
    return F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b < size))


# ------------------------------------------------------------------ index and probe

def _hex(sig) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), DIGITS, "0"))), "")


def _paths(signed: DataFrame, num_perm: int, *columns) -> DataFrame:
    """A row for each tree: ``tree`` and ``path``, the values from ``sig[tree]`` on."""
    paths = let(_hex("sig"), lambda digits: F.transform(
        F.sequence(F.lit(0), F.lit(num_perm - 1)), lambda t: F.substring(digits, DIGITS * t + 1, F.lit(DIGITS * DEPTH))))
    return unnest(signed, paths, *columns, name="path", at="tree")


def lsh_index(sigs: DataFrame, bounds: list[int], num_perm: int = NUM_PERM) -> DataFrame:
    """MH2: ``(part, tree, path, key)``, one row for each set and tree."""
    part = partition_of(F.col("size"), bounds).alias("part")
    return _paths(sigs, num_perm, part, "key").select("part", "tree", "path", "key")


def build_lsh_index(rows: DataFrame | Sets, num_perm: int = NUM_PERM, num_part: int = NUM_PART) -> tuple[list[int], DataFrame]:
    """MH2: upper sizes of the parts and the index of :func:`set_rows`, or of sets still to be built.

    The signatures are written once to the shared checkpoint folder."""
    ensure_checkpoint_dir((rows.df if isinstance(rows, Sets) else rows).sparkSession)
    sigs = set_signatures(rows, num_perm).checkpoint()
    histogram = sorted(map(tuple, size_histogram(sigs).collect()))
    bounds = size_bounds([(n, total, top) for _, n, total, top in histogram], num_part)
    return bounds, lsh_index(sigs, bounds, num_perm)


def save_lsh_index(bounds: list[int], index: DataFrame, path: str) -> None:
    """Store an index sorted by (tree, path), a folder for each part; a prefix is then a range of few row groups."""
    spark = index.sparkSession
    spark.createDataFrame([(b,) for b in bounds], "bound bigint").coalesce(1).write.parquet(f"{path}/bounds")
    (index.repartitionByRange("part", "tree", "path").sortWithinPartitions("part", "tree", "path")
     .write.partitionBy("part").parquet(f"{path}/rows"))


def load_lsh_index(spark: SparkSession, path: str) -> tuple[list[int], DataFrame]:
    bounds = sorted(r["bound"] for r in spark.read.parquet(f"{path}/bounds").collect())
    return bounds, spark.read.parquet(f"{path}/rows").select("part", "tree", "path", "key")


def layout(upper: int, q_size: int, threshold: float, num_perm: int = NUM_PERM) -> tuple[int, int]:
    """(trees, prefix length) for queries of ``q_size`` in a part of sets up to ``upper``."""
    s = min(threshold / (upper / q_size + 1.0 - threshold), 1.0)
    for r in range(DEPTH, 0, -1):
        hit = s ** r
        need = 1 if hit >= 1.0 else math.ceil(math.log(1.0 - RECALL) / math.log(1.0 - hit)) if hit > 1e-12 else num_perm + 1
        if need <= num_perm // r:
            return need, r
    return num_perm, 1


def probe_plan(bounds: list[int], most: int, threshold: float, num_perm: int = NUM_PERM) -> list[tuple[int, int, int, int]]:
    """(part, qb, trees, r) for query sizes from qb to 2 qb - 1; parts that can't hold an answer have no row."""
    plan, qb = [], 1
    while qb <= most:
        plan += [(part, qb, *layout(u, qb, threshold, num_perm)) for part, u in enumerate(bounds) if u >= threshold * qb]
        qb *= 2
    return plan


def lsh_candidates(query_sigs: DataFrame, bounds: list[int], index: DataFrame, threshold: float = 0.8,
                   num_perm: int = NUM_PERM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(qkey, key)``: pairs that share a prefix of the chosen length in a chosen tree.

    ``query_sigs``: ``(qkey, size, sig)``. The plan has a row for each part and
    power of two, so it is broadcast; the queries are where they are small."""
    spark = query_sigs.sparkSession
    n, most = query_sigs.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    planned = probe_plan(bounds, most, threshold, num_perm)
    plan = spark.createDataFrame(planned, "part int, qb bigint, trees int, r int")
    used = spark.createDataFrame(sorted({(part, i * r) for part, _, trees, r in planned for i in range(trees)}), "part int, tree int")
    qb = F.expr("shiftleft(1L, length(bin(size)) - 1)")
    asked = _paths(query_sigs, num_perm, "qkey", qb.alias("qb")).withColumnRenamed("path", "qpath")
    asked = asked.withColumn("head", F.substring("qpath", 1, DIGITS))
    if n * num_perm * (DIGITS * (DEPTH + 1) + 48) <= broadcast_bytes:
        asked = F.broadcast(asked)
    rows = index.join(F.broadcast(used), ["part", "tree"], "left_semi").withColumn("head", F.substring("path", 1, DIGITS))
    met = rows.join(asked, ["tree", "head"]).join(F.broadcast(plan), ["part", "qb"])
    prefix = F.expr(f"substring(qpath, 1, {DIGITS} * r)")
    in_range = (F.col("path") >= prefix) & (F.col("path") < F.concat(prefix, F.lit("g")))  # 'g' follows every hex digit
    chosen = (F.col("tree") % F.col("r") == 0) & (F.col("tree") < F.col("trees") * F.col("r"))
    return met.where(chosen & in_range).select("qkey", "key").distinct()


def containment_lsh(queries: Sets, indexed: Sets, threshold: float = 0.8,
                    num_perm: int = NUM_PERM, num_part: int = NUM_PART, broadcast_bytes: int = BROADCAST_BYTES,
                    built: tuple[list[int], DataFrame] | None = None) -> DataFrame:
    """MH3: ``(qkey, key, overlap, q_size, containment)`` as the exact search gives them, but for pairs the index misses.

    ``built`` is an index of ``indexed`` made (or loaded) before. Only the sets that are candidates are built again."""
    bounds, index = built or build_lsh_index(indexed, num_perm, num_part)
    ensure_checkpoint_dir(queries.df.sparkSession)
    qsigs = set_signatures(queries, num_perm).withColumnRenamed("key", "qkey").checkpoint()
    cand = lsh_candidates(qsigs, bounds, index, threshold, num_perm, broadcast_bytes).checkpoint()
    keys = broadcast_if_small(cand.select("key").distinct(), F.lit(64), broadcast_bytes)
    qs = queries.members().withColumnRenamed("key", "qkey")
    return verify_containment(cand, qs, indexed.members(keys), qsigs.select("qkey", F.col("size").alias("q_size")), threshold)
