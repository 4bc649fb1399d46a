"""Set containment search: MinHash and exact containment (MH1, MH4-MH6).

Sets are word n-gram shingle sets ``(key, shingle)``. The question is: which
indexed sets X contain at least a fraction ``t`` of a query set Q,
``|Q n X| / |Q| >= t``.

* :func:`containment_exact` answers it exactly with an inverted-index join.
  Only the query shingle vocabulary (broadcast below a checked size) is kept
  from the index side, so the corpus is filtered map-side. A prefix filter
  bounds the pairs: X can only reach ``m`` shared shingles if it shares one of
  the ``q - m + 1`` rarest shingles of Q, so candidates come from a join on
  rare shingles and hot shingles never fan out into pairs on their own.
* The LSH Ensemble (MH2, MH3) is in :mod:`corpusprobe.operators.lsh_ensemble`.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprobe.functions.text import ngram_set, unnest, ws_tokens
from corpusprobe.session import ensure_checkpoint_dir

PRIME = (1 << 31) - 1
NUM_PERM = 128
SEED = 1
BROADCAST_BYTES = 32 * 1024 * 1024


def permutations(num_perm: int = NUM_PERM, seed: int = SEED) -> list[tuple[int, int]]:
    """(a, b) of the hash functions (a*h + b) mod p, drawn from a seeded rule."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(0, PRIME)) for _ in range(num_perm)]


def shingle_hash(col) -> "F.Column":
    """32-bit md5 prefix reduced mod p (the same value in any engine with md5)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint"), F.lit(PRIME))


def shingle_sets(df: DataFrame, key_col: str, text_col: str = "text", n: int = 5,
                 unique_keys: bool = True) -> DataFrame:
    """``(key, shingle)``: distinct word n-grams of each row's text.

    Each row's set is de-duplicated inside the row; with ``unique_keys`` (one
    row per key, e.g. a document id) that already is the set and no shuffle is
    needed. Otherwise rows of a key are merged by a global ``distinct``.
    """
    sets = unnest(df, ngram_set(ws_tokens(text_col), n), F.col(key_col).alias("key"), name="shingle")
    return sets if unique_keys else sets.distinct()


def set_sizes(shingles: DataFrame) -> DataFrame:
    return shingles.groupBy("key").agg(F.count(F.lit(1)).cast("bigint").alias("size"))


def minhash_signatures(shingles: DataFrame, num_perm: int = NUM_PERM, seed: int = SEED) -> DataFrame:
    """MH1: ``(key, size, sig array<bigint>)``.

    One partial + final hash aggregate with ``num_perm`` min buffers per key;
    every product stays below 2**62, inside bigint under ANSI mode.
    """
    h = shingles.select("key", shingle_hash("shingle").alias("h"))
    mins = [F.min(F.pmod(F.lit(a) * F.col("h") + F.lit(b), F.lit(PRIME))).alias(f"m{i}")
            for i, (a, b) in enumerate(permutations(num_perm, seed))]
    agg = h.groupBy("key").agg(F.count(F.lit(1)).cast("bigint").alias("size"), *mins)
    return agg.select("key", "size", F.array(*[F.col(f"m{i}") for i in range(num_perm)]).alias("sig"))


def minhash_estimate(sig1, sig2) -> "F.Column":
    """MH6: fraction of equal signature positions (a Jaccard estimate)."""
    eq = F.zip_with(sig1, sig2, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(eq, F.lit(0), lambda acc, x: acc + x) / F.size(sig1)


def broadcast_if_small(df: DataFrame, row_bytes, limit: int) -> DataFrame:
    size = df.agg(F.sum(row_bytes).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= limit else df


def _min_shared(q_size, threshold: float):
    """A lower bound on the shared shingles any answer needs (one below
    ceil(t*q) to stay clear of float rounding; verification is exact)."""
    return F.greatest(F.ceil(q_size * F.lit(threshold)) - 1, F.lit(0))


def containment_exact(queries: DataFrame, index: DataFrame, threshold: float = 0.8,
                      broadcast_bytes: int = BROADCAST_BYTES, materialize: bool = True) -> DataFrame:
    """MH4: ``(qkey, key, overlap, q_size, containment)`` with containment >= t.

    ``queries`` and ``index`` are ``(key, shingle)`` sets: distinct pairs, as
    :func:`shingle_sets` returns them (queries are de-duplicated here).
    """
    qs = queries.select(F.col("key").alias("qkey"), "shingle").distinct()
    qsize = qs.groupBy("qkey").agg(F.count(F.lit(1)).alias("q_size"))
    vocab = broadcast_if_small(qs.select("shingle").distinct(), F.length("shingle") + 32,
                                broadcast_bytes)
    ds = index.select("key", "shingle").join(vocab, "shingle", "left_semi")
    if materialize:
        # The index side filtered to the query vocabulary feeds three joins;
        # one corpus pass writes it to the shared checkpoint folder.
        ensure_checkpoint_dir(index.sparkSession)
        ds = ds.checkpoint()
    dfreq = ds.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = Window.partitionBy("qkey").orderBy("df0", "shingle")
    prefix = (qs.join(dfreq, "shingle", "left").join(qsize, "qkey")
              .withColumn("df0", F.coalesce("df", F.lit(0)))
              .withColumn("rk", F.row_number().over(by_rarity))
              .where(F.col("rk") <= F.col("q_size") - _min_shared(F.col("q_size"), threshold) + 1)
              .select("qkey", "shingle"))
    cand = prefix.join(ds, "shingle").select("qkey", "key").distinct()
    return verify_containment(cand, qs, ds, qsize, threshold)


def verify_containment(cand: DataFrame, qs: DataFrame, ds: DataFrame, qsize: DataFrame,
                       threshold: float) -> DataFrame:
    """Exact overlap for candidate pairs ``(qkey, key)``."""
    shared = (cand.join(ds, "key")
              .join(qs, ["qkey", "shingle"], "left_semi")
              .groupBy("qkey", "key").agg(F.count(F.lit(1)).cast("bigint").alias("overlap")))
    out = shared.join(qsize, "qkey").select(
        "qkey", "key", "overlap", F.col("q_size").cast("bigint").alias("q_size"),
        (F.col("overlap") / F.col("q_size")).alias("containment"))
    return out.where(F.col("containment") >= F.lit(threshold))


def index_membership(keys: DataFrame, index_keys: DataFrame, key_col: str = "key") -> DataFrame:
    """MH5: ``(key, member)``: is the key in the index."""
    idx = index_keys.select(F.col(key_col).alias("_k")).distinct().withColumn("_m", F.lit(True))
    return (keys.select(F.col(key_col).alias("key")).join(idx, F.col("key") == F.col("_k"), "left")
            .select("key", F.coalesce("_m", F.lit(False)).alias("member")))
