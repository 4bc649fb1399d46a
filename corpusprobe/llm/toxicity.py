"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear (logistic) models
over word presence; the model of a category also sees the logits that the
earlier ones gave the document. While training, those inputs are out-of-fold
predictions: each fold is predicted by a model that didn't see it, so a later
model learns how far it may trust an earlier one on new documents. The models
that score are then fitted on all training rows.

Training uses at most ``MAX_TRAIN`` labelled documents (those of smallest
hash); words are hashed to ``BUCKETS``, and each model keeps the ``FEATURES``
buckets that tell its category best (by the training rows of that model).

The chain of the query is ``low_quality -> toxic -> toxic_low_quality``, from
the two label columns there are; any list of 0/1 columns will do.

Defined results: null and empty texts are scored by the biases; rows whose
label is null are not learned from; without usable labels all probabilities
are 0.5 and nothing is flagged; repeated rows are scored each; an empty table
gives an empty result; extra columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, alnum_words, text_bytes

MAX_TRAIN = 12000
BUCKETS = 1 << 18
FEATURES = 600
FOLDS = 4
STEPS, RATE, DECAY = 150, 0.5, 2e-4
FLAG_AT = 0.4


@dataclass
class Link:
    """One model of the chain: chosen buckets, their weights, weights of the earlier logits, bias."""
    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        out = self.bias + earlier @ self.earlier
        dense = np.zeros(BUCKETS)
        dense[self.buckets] = self.weights
        return out + np.array([dense[r].sum() for r in rows])


def present(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct buckets of the words of a text."""
    words = set(alnum_words(raw))
    ids = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    return np.unique(ids % np.uint64(BUCKETS)).astype(np.int64)


def fit_link(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> Link:
    """Logistic regression with weight decay on the most telling buckets."""
    flat = np.concatenate([*rows, np.empty(0, dtype=np.int64)])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    df = np.bincount(flat, minlength=BUCKETS)
    pos = np.bincount(flat, weights=y[of], minlength=BUCKETS)
    rate = y.mean()
    gain = (pos - df * rate) ** 2 / np.maximum(df * rate * (1 - rate), 1e-9)
    gain[df < 3] = 0
    buckets = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    buckets = buckets[gain[buckets] > 0]
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))
    use = place[flat] >= 0
    x = np.zeros((len(rows), len(buckets) + earlier.shape[1]), dtype=np.float32)
    x[of[use], place[flat[use]]] = 1
    x[:, len(buckets):] = earlier
    w, g2 = np.zeros(x.shape[1], dtype=np.float32), np.full(x.shape[1], 1e-6, dtype=np.float32)
    y = y.astype(np.float32)
    bias, b2 = float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), 1e-6
    for _ in range(STEPS):
        err = 1 / (1 + np.exp(-np.clip(x @ w + np.float32(bias), -30, 30))) - y
        g = x.T @ err / len(y) + DECAY * w
        g2 += g * g
        w -= RATE * g / np.sqrt(g2)
        b2 += err.mean() ** 2
        bias -= 0.1 * RATE * err.mean() / b2 ** 0.5
    return Link(buckets, w[:len(buckets)], w[len(buckets):], bias)


def fit_chain(rows: list[np.ndarray], targets: np.ndarray, folds: np.ndarray) -> list[Link]:
    """One model per column of ``targets``, later ones on out-of-fold logits."""
    earlier, chain = np.zeros((len(rows), 0)), []
    for y in targets.T.astype(float):
        chain.append(fit_link(rows, earlier, y))
        oof = np.zeros(len(rows))
        for f in np.unique(folds):
            seen, own = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            if not len(seen):
                seen = own
            link = fit_link([rows[i] for i in seen], earlier[seen], y[seen])
            oof[own] = link.logits([rows[i] for i in own], earlier[own])
        earlier = np.column_stack([earlier, np.clip(oof, -10, 10)])
    return chain


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str]) -> pd.DataFrame:
    known = labels.where(" and ".join(f"`{c}` in (0, 1)" for c in categories)).groupBy("doc_id").agg(
        *[F.max(c).alias(c) for c in categories])
    chosen = known.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(MAX_TRAIN)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn(
        "fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS))).orderBy("doc_id").limit(MAX_TRAIN).toPandas()


def score_chain(docs: DataFrame, chain: list[Link], categories: list[str]) -> DataFrame:
    """``doc_id`` and a probability ``p_<category>`` for each category."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [present(raw, hashes) for raw in text_bytes(batch)]
            earlier, probs = np.zeros((len(rows), 0)), []
            for link in chain:
                z = link.logits(rows, earlier)
                earlier = np.column_stack([earlier, np.clip(z, -10, 10)])
                probs.append(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *probs], names=["doc_id", *[f"p_{c}" for c in categories]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, ", ".join(["doc_id long", *[f"p_{c} double" for c in categories]]))


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """Fit the chain on labelled documents and score all documents."""
    rows = training_rows(docs, labels, categories)
    if rows.empty:
        none = Link(np.empty(0, dtype=np.int64), np.empty(0), np.empty(0), 0.0)
        chain = [Link(none.buckets, none.weights, np.zeros(i), -1e-9) for i in range(len(categories))]
    else:
        hashes = WordHashes()
        texts = [present((t or "").encode(), hashes) for t in rows["text"]]
        chain = fit_chain(texts, rows[categories].to_numpy(), rows["fold"].to_numpy())
    return score_chain(docs, chain, categories)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Probabilities of the chain and ``toxic`` (0/1) for every document."""
    known = labels.where("quality in (0, 1) and toxic in (0, 1)").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic",
        ((1 - F.col("quality")) * F.col("toxic")).alias("toxic_low_quality"))
    out = toxicity(docs, known, ["low_quality", "toxic", "toxic_low_quality"])
    return out.withColumn("toxic", F.when(F.col("p_toxic") >= FLAG_AT, 1).otherwise(0))
