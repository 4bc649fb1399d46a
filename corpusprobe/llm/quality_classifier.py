"""Quality classifier from supervised subword embeddings.

A word's features are the word itself and its byte n-grams of 3 to 5 within
``<word>``, hashed into ``BUCKETS`` rows of an embedding matrix; a word that
repeats the one before it counts as the word ``SAME``. A document is the mean
of all its feature vectors; a softmax layer on top gives the class.
Both layers are learned together by stochastic gradient descent in numpy
(step sizes by accumulated squared gradients) on a bounded sample of labelled
rows: the ``MAX_TRAIN`` rows of smallest hash among those outside the held-out
fifth (``crc32(doc_id) % 5 = 0``).

As the layers are linear up to the softmax, scoring needs one number per
feature: a word's features are summed once and remembered, and a document's
logit is a mean over its words. Labels, language, source and id are no inputs.

Defined results: null and empty texts get the score of the bias alone; null
labels are not learned from; without any usable label every score is 0.5;
repeated rows are scored each; an empty table gives an empty result; extra
columns of the input don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, text_bytes

HELD_OUT_MOD = 5
THRESHOLD = 0.3
#: Labelled rows that training uses at most.
MAX_TRAIN = 3000
BUCKETS, DIM = 1 << 15, 16
NGRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.2, 7


SAME = b"\x00same"


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text in their case, immediate repetitions marked."""
    words = raw.split()
    return [w if w != before else SAME for before, w in zip([b"", *words], words, strict=False)]


def features(word: bytes) -> list[int]:
    """Buckets of the word and its n-grams."""
    inner = b"<" + word + b">"
    out = [zlib.crc32(inner) % BUCKETS]
    for n in NGRAMS:
        out += [zlib.crc32(inner[i:i + n], n) % BUCKETS for i in range(len(inner) - n + 1)]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> pd.DataFrame:
    """``text``, ``y`` of at most ``MAX_TRAIN`` labelled documents."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = (known.where(bucket_of(F.col("doc_id"), HELD_OUT_MOD) != 0)
              .orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(MAX_TRAIN))
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").orderBy("doc_id").limit(
        MAX_TRAIN).toPandas()


def _counts(texts: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    known: dict[bytes, np.ndarray] = {}
    rows = []
    for text in texts:
        words = Counter(tokens((text or "").encode()))
        for w in words:
            if w not in known:
                known[w] = np.array(features(w), dtype=np.int32)
        if words:
            flat = np.concatenate([known[w] for w in words])
            times = np.repeat(list(words.values()), [len(known[w]) for w in words])
            full = np.bincount(flat, weights=times, minlength=BUCKETS)
            at = np.flatnonzero(full).astype(np.int32)
            rows.append((at, (full[at] / full[at].sum()).astype(np.float32)))
        else:
            rows.append((np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)))
    return rows


def train(rows: pd.DataFrame) -> tuple[np.ndarray, float]:
    """Per bucket the logit of label 1 against 0, and the bias."""
    if rows.empty:
        return np.zeros(BUCKETS, dtype=np.float32), 0.0
    rng = np.random.default_rng(SEED)
    y = rows["y"].to_numpy(dtype=int)
    mean = _counts(rows["text"])
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    out[0, 1] = 1.0
    sums = [np.full_like(x, 1e-6) for x in (emb, out, bias)]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            batch = order[at:at + BATCH]
            x = np.zeros((len(batch), BUCKETS), dtype=np.float32)
            for i, d in enumerate(batch):
                x[i, mean[d][0]] = mean[d][1]
            hidden = x @ emb
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            grads = (x.T @ (p @ out.T), hidden.T @ p, p.sum(axis=0))
            for value, total, g in zip((emb, out, bias), sums, grads, strict=True):
                total += g * g
                value -= rate * g / np.sqrt(total)
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class WordLogits(dict):
    """word -> (sum of its features' logits, number of features), remembered up to a bound."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[float, int]:
        if len(self) >= 300_000:
            self.clear()
        at = features(word)
        out = self[word] = (float(self.weights[at].sum()), len(at))
        return out


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        logits = WordLogits(weights)
        for batch in batches:
            means = []
            for raw in text_bytes(batch):
                total, n = 0.0, 0
                for a, b in map(logits.__getitem__, tokens(raw)):
                    total += a
                    n += b
                means.append(total / n if n else 0.0)
            z = np.clip(np.array(means) + bias, -30, 30)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights, bias = train(training_rows(docs, labels, "quality"))
    return score_quality(docs, weights, bias).select(
        "doc_id", (bucket_of(F.col("doc_id"), HELD_OUT_MOD) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
