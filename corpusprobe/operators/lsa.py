"""Latent semantic encoder (EMB1): weighted term vectors reduced by a randomised factorisation.

A document is its token counts over ``BUCKETS`` md5 buckets, weighted by inverse
document frequency and scaled to length 1; the encoder projects it on the leading
right singular vectors of the matrix of all documents. They are found by
randomised subspace iteration: a seeded random basis is multiplied by A'A,
``ROUNDS`` times, with a QR factorisation between rounds. A round is one pass:
tasks multiply blocks of their own documents and add up a ``BUCKETS`` x k
matrix, whose rows are then summed by bucket. What reaches the driver, and goes
out again with the next round, is that matrix: its size depends on the buckets
and dimensions only. Fitting covers all documents; token buckets are written
once to the shared checkpoint folder and read by every round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprobe.session import ensure_checkpoint_dir

BUCKETS, DIM, EXTRA, ROUNDS, SEED = 4096, 64, 16, 4, 1066
#: Documents multiplied at once (a dense block of BUCKETS columns).
BLOCK = 256


#: Tokens whose buckets a task remembers.
REMEMBERED = 200_000


class TokenBuckets(dict):
    """token -> md5 bucket, as :func:`~corpusprobe.operators.embed.token_buckets` gives it, remembered up to a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        b = self[token] = int(md5(token.encode(), usedforsecurity=False).hexdigest()[:8], 16) % self.buckets
        return b

    def rows(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The buckets of each text's tokens; ``split`` knows the same white space as ``ws_tokens``."""
        return [np.fromiter(map(self.__getitem__, (t or "").split()), dtype=np.int64) for t in texts]


@dataclass
class LsaModel:
    """``weights`` of the buckets (idf), ``basis`` (buckets x dim), singular values and number of documents."""

    weights: np.ndarray
    basis: np.ndarray
    singular: np.ndarray
    n: int


def term_block(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The weighted, length-1 rows of some documents, given their token buckets."""
    dim = len(weights)
    cells = np.repeat(np.arange(len(rows)) * dim, [len(r) for r in rows])
    if len(cells):
        cells = cells + np.concatenate(rows)
    block = np.bincount(cells, minlength=len(rows) * dim).reshape(len(rows), dim) * weights
    length = np.sqrt((block * block).sum(axis=1, keepdims=True))
    return block / np.where(length > 0, length, 1)


def _blocks(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The token buckets of an Arrow column's rows, ``BLOCK`` rows at a time."""
    sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    ends, flat = np.cumsum(sizes), column.flatten().to_numpy()
    for at in range(0, len(sizes), BLOCK):
        yield [flat[ends[i] - sizes[i]:ends[i]] for i in range(at, min(at + BLOCK, len(sizes)))]


def _summed(partial: DataFrame, buckets: int, width: int) -> np.ndarray:
    """The matrix whose rows (``i``, ``row``) were added up by each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column("row").flatten().to_numpy().reshape(batch.num_rows, width)
            for i, row in zip(batch.column("i").to_pylist(), cells, strict=True):
                total[i] = total[i] + row if i in total else row.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                                         names=["i", "row"])

    out = np.zeros((buckets, width))
    for r in partial.repartition("i").mapInArrow(rows, "i int, row array<double>").collect():
        out[r["i"]] = r["row"]
    return out


def gram_times(rows: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times ``basis``, in one pass over the token buckets ``b`` of all documents."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for some in _blocks(batch.column("b")):
                a = term_block(some, weights)
                total += a.T @ (a @ basis)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64()))],
                                         names=["i", "row"])

    return _summed(rows.mapInArrow(multiply, "i int, row array<double>"), *basis.shape)


def fit_lsa(df: DataFrame, text_col: str = "text", dim: int = DIM, buckets: int = BUCKETS, rounds: int = ROUNDS,
            extra: int = EXTRA, seed: int = SEED) -> LsaModel:
    """The encoder of a corpus; documents without a token count for nothing."""
    ensure_checkpoint_dir(df.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenBuckets(buckets)
        for batch in batches:
            some = [b.astype(np.int32) for b in known.rows(batch.column(0).to_pylist()) if len(b)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.int32()))], names=["b"])

    rows = df.select(F.col(text_col).cast("string")).mapInArrow(hashed, "b array<int>").checkpoint()
    n = rows.count()
    found = rows.select(F.explode(F.array_distinct("b")).alias("i")).groupBy("i").count().collect()
    df_of = np.zeros(buckets)
    df_of[[r["i"] for r in found]] = [r["count"] for r in found]
    weights = np.log((1 + n) / (1 + df_of)) + 1
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, min(dim + extra, buckets))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(gram_times(rows, weights, basis))[0]
    inner = basis.T @ gram_times(rows, weights, basis)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    top = np.argsort(-values)[:dim]
    return LsaModel(weights, basis @ turn[:, top], np.sqrt(np.maximum(values[top], 0)), n)


def lsa_encoder(model: LsaModel):
    """``encoder(text column) -> array<float>`` for :func:`~corpusprobe.operators.embed.embed_text`:
    length 1, or zeros for a text without tokens."""
    import pandas as pd

    weights, basis = model.weights, model.basis

    def project(texts):
        rows = TokenBuckets(len(weights)).rows(texts)
        out = [term_block(rows[at:at + BLOCK], weights) @ basis for at in range(0, len(rows), BLOCK)]
        found = np.concatenate(out) if out else np.zeros((0, basis.shape[1]))
        length = np.sqrt((found * found).sum(axis=1, keepdims=True))
        return pd.Series(list((found / np.where(length > 0, length, 1)).astype(np.float32)))
    # Real (not postponed) hints: the UDF kind is read from them.
    project.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(project, "array<float>")

    def encode(text) -> Column:
        return udf((F.col(text) if isinstance(text, str) else text).cast("string"))
    return encode
