"""Document embedding (EMB1-EMB3, FLT7, UDF2).

``embed_text`` adds an ``embedding array<float>`` column and keeps every other
column. Three encoders:

* ``hashed_bow_embedding`` (offline default): whitespace tokens hashed by md5
  into ``dim`` buckets in the JVM, counted and L2-normalised by one numpy
  ``bincount`` per Arrow batch, map-only (no shuffle).
* ``lsa.lsa_encoder``: weighted term vectors reduced by a factorisation fitted
  on the corpus (:mod:`corpusprobe.operators.lsa`).
* ``embed_with_model``: any batch encoder through ``predict_batch_udf``
  (Arrow batches of ``batch_size`` rows; the model is built once per Python
  worker by ``make_predict_fn``). Device placement is Spark's resource
  scheduling (``spark.task.resource.gpu.amount``), not a rank argument.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprobe.functions.text import ws_tokens

DIM = 64
SHUFFLE_SEED = "1066"


def _bucket(token: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def token_buckets(text, dim: int = DIM) -> Column:
    """``array<bigint>``: the md5 bucket of every whitespace token."""
    return F.transform(ws_tokens(text), lambda t: _bucket(t, dim))


def _histogram_udf(dim: int):
    import numpy as np
    import pandas as pd

    def normalised_histogram(buckets):
        rows = [() if b is None else b for b in buckets]
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        cells = np.repeat(np.arange(len(rows)) * dim, sizes)
        if len(cells):
            cells += np.concatenate(rows).astype(np.int64)
        c = np.bincount(cells, minlength=len(rows) * dim).reshape(len(rows), dim).astype(np.float64)
        n = np.sqrt((c * c).sum(axis=1, keepdims=True))
        return pd.Series(list((c / np.where(n > 0, n, 1)).astype(np.float32)))
    # Real (not postponed) hints: the UDF kind is read from them.
    normalised_histogram.__annotations__ = {"buckets": pd.Series, "return": pd.Series}
    return F.pandas_udf(normalised_histogram, "array<float>")


def hashed_bow_embedding(text, dim: int = DIM) -> Column:
    """L2-normalised bucket counts as ``array<float>`` (zeros for empty text).

    Buckets are computed in the JVM; the histograms of a batch are one
    numpy ``bincount`` in an Arrow-batched pandas UDF (map-only, no shuffle).
    """
    return _histogram_udf(dim)(token_buckets(text, dim))


def embed_text(df: DataFrame, text_col: str = "text", dim: int = DIM,
               encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """EMB1: all columns of ``df`` plus ``embedding``."""
    enc = encoder or (lambda c: hashed_bow_embedding(c, dim))
    return df.withColumn("embedding", enc(F.col(text_col)))


def embed_with_model(df: DataFrame, make_predict_fn, text_col: str = "text", dim: int = DIM,
                     batch_size: int = 16) -> DataFrame:
    """EMB1/UDF2 with a real model: ``make_predict_fn() -> fn(np.ndarray[str]) ->
    np.ndarray[float32, (n, dim)]``, run on Arrow batches of ``batch_size``."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()),
                            batch_size=batch_size)
    return df.withColumn("embedding", udf(F.col(text_col)))


def _draw(key_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key_col).cast("string"), F.lit("")), F.lit(seed)))


def seeded_subset(df: DataFrame, n: int, key_col: str = "doc_id", seed: str = SHUFFLE_SEED) -> DataFrame:
    """FLT7: a reproducible shuffle (order by md5 of key and seed), the first n rows, in no order.

    The limit is the feature (a sample of n). No task sorts the sample: the draws are
    evenly spread numbers, so a band about the n-th one is known from the number of
    rows. Rows below the band stay as they are; only the band is sorted and cut. If
    the band missed the n-th draw (or keys repeat much), it is widened and counted again.
    """
    bits = 52
    rows = df.withColumn("_draw", _draw(key_col, seed))
    spot = F.conv(F.substring("_draw", 1, bits // 4), 16, 10).cast("bigint")
    total = df.count()
    if n >= total:
        return df
    width = 6 * max(n, 1) ** 0.5 + 10
    while True:
        low, high = (int(min(max(x / total, 0), 1) * (1 << bits)) for x in (n - width, n + width))
        below, inside = rows.agg(F.count_if(spot < low), F.count_if((spot >= low) & (spot < high))).first()
        if below <= n <= below + inside:
            break
        width *= 8
    band = rows.where((spot >= low) & (spot < high)).orderBy(F.col("_draw")).limit(n - below)
    return rows.where(spot < low).unionByName(band).drop("_draw")
