"""Embedding whitening with eigenpairs found by spectrum slicing.

Rows whose vector is null or holds a null or non-finite entry are dropped. Each
remaining entry c becomes the integer x = floor(1024 c) + 100000.

1. One pass gives the number of rows n and the sums S by dimension, as exact
   integers; a second one the covariance V of x, centred before multiplying,
   divisor n. Tasks add up their own rows and send a row a dimension, which are
   added by dimension; d numbers and d x d numbers reach the driver, whatever
   the number of rows.
2. The leading eigenpairs of V, on the driver: an LDL' factorisation of V - s
   with symmetric pivoting has as many positive pivots as V has eigenvalues
   above s (Sylvester). Such counts bisect the spectrum until an interval holds
   the k-th eigenvalue alone; Rayleigh quotient iteration then converges
   cubically, and is taken up again in a narrower interval if it leaves its own;
   counts just below and just above the result certify that it is the k-th.
   Eigenvalues that rounding can't tell apart are one cluster, whose basis comes
   from inverse iteration on a block.
3. A third pass measures the covariance of the whitened rows against the
   identity, the last one returns them.

Defined results: shorter vectors count as filled up with 0.0 to the longest
remaining one; entries beyond ``MAX_X`` are held at it; with under eight
dimensions there are as many components as dimensions; a component whose
eigenvalue is zero to rounding (constant columns, a single row) has a null
``whitened`` and stays out of ``identity_error``, which is null if all do;
``explained`` is null if the trace is zero; ``deviation`` is null where it
exceeds a long; repeated and null ids stay as rows; an empty table, or one
without valid vectors or with empty ones only, gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
MAX_X = 2**40
#: Rows turned into one matrix at a time, in entries.
CHUNK_ENTRIES = 2_000_000
#: Bunch-Kaufman growth bound (1 + sqrt 17) / 8.
ALPHA = (1 + 17**0.5) / 8

_LONG = 2**63 - 1


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that remain."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.where("vector is not null").where(~F.exists("vector", odd))


def entries(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and the integer matrix of the rows of a batch, in chunks."""
    rows = max(1, CHUNK_ENTRIES // max(1, dims))
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        column = part.column("vector")
        lens = pc.list_value_length(column).to_numpy().astype(np.int64)
        flat = np.clip(np.floor(SCALE * column.flatten().to_numpy()), -MAX_X, MAX_X).astype(np.int64) + OFFSET
        if (lens == dims).all():
            x = flat.reshape(len(lens), dims)
        else:
            x = np.full((len(lens), dims), OFFSET, dtype=np.int64)
            x[np.arange(dims) < lens[:, None]] = flat
        yield part.column("vec_id"), x


def added(partial: DataFrame) -> DataFrame:
    """``i``, ``row``: the rows of the same ``i`` of all tasks added up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
                total[i] = total[i] + np.array(row) if i in total else np.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                                         names=["i", "row"])

    return partial.repartition("i").mapInArrow(rows, "i int, row array<double>")


def matrix_of(summed: DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for r in summed.collect():
        out[r["i"]] = r["row"]
    return out


def sums(valid: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and the exact sums of x by dimension."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for batch in batches:
            for _, x in entries(batch, dims):
                n += len(x)
                total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()), pa.array([n, *total], pa.int64())],
                                         names=["i", "x"])

    found = {r["i"]: int(r["x"]) for r in valid.mapInArrow(rows, "i int, x long").groupBy("i").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


class Centre:
    """Deviations of integer rows from the mean S/n, without loss for large x: x - S/n = (x - c) - r/n with integers c, r."""

    def __init__(self, n: int, total: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in total], dtype=np.int64)
        self.rest = [s % n for s in total]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, in integers of any size."""
        z, n = x - self.whole, self.n
        rest = np.array(self.rest, dtype=object)
        most = int(np.abs(z).max(initial=0)) + 1
        if len(rest) * most * max(most, n) < _LONG:
            squares, mixed = (z * z).sum(axis=1), z @ rest.astype(np.int64)
        else:
            z = z.astype(object)
            squares, mixed = (z * z).sum(axis=1), z @ rest
        own = sum(r * r for r in self.rest)
        every = [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, mixed, strict=True)]
        return [v if v <= _LONG else None for v in every]


def covariance(valid: DataFrame, dims: int, centre: Centre, basis: np.ndarray | None = None) -> np.ndarray:
    """Of x, or of x projected on the columns of ``basis``; divisor n, centred before multiplying."""
    size = dims if basis is None else basis.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in entries(batch, dims):
                y = centre.centred(x)
                y = y if basis is None else y @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["i", "row"])

    return matrix_of(added(valid.mapInArrow(rows, "i int, row array<double>")), size) / centre.n


def inertia(a: np.ndarray) -> tuple[int, int]:
    """Numbers of positive and of negative pivots of P a P' = L D L' (1 x 1 and 2 x 2 pivots, Bunch-Kaufman)."""
    a = a.copy()
    positive = negative = k = 0
    n = len(a)
    while k < n:
        column = np.abs(a[k + 1:, k])
        off = column.max(initial=0.0)
        step, with_row = 1, k
        if off > 0 and abs(a[k, k]) < ALPHA * off:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            beside = row.max()
            if abs(a[k, k]) * beside < ALPHA * off * off:
                with_row = r
                step = 1 if abs(a[r, r]) >= ALPHA * beside else 2
        at = k + step - 1
        if with_row != at:
            a[[at, with_row]] = a[[with_row, at]]
            a[:, [at, with_row]] = a[:, [with_row, at]]
        pivot, below = a[k:k + step, k:k + step], a[k + step:, k:k + step]
        if step == 2:  # such a pivot has a negative determinant
            positive, negative = positive + 1, negative + 1
            a[k + 2:, k + 2:] -= below @ np.linalg.solve(pivot, below.T)
        elif pivot[0, 0] != 0:
            positive, negative = positive + int(pivot[0, 0] > 0), negative + int(pivot[0, 0] < 0)
            a[k + 1:, k + 1:] -= below @ below.T / pivot[0, 0]
        k += step
    return positive, negative


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` lie above ``shift``."""
    return inertia(v - shift * np.eye(len(v)))[0]


def solved(a: np.ndarray, b: np.ndarray, tiny: float) -> np.ndarray:
    """a^-1 b; a singular matrix, as at an exact eigenvalue, is moved by ``tiny``."""
    try:
        x = np.linalg.solve(a, b)
        if np.isfinite(x).all():
            return x
    except np.linalg.LinAlgError:
        pass
    return np.linalg.solve(a + tiny * np.eye(len(a)), b)


def rayleigh(v: np.ndarray, lo: float, hi: float, tiny: float, found: np.ndarray) -> tuple[float, np.ndarray] | None:
    """The eigenpair alone in (lo, hi] by Rayleigh quotient iteration; None if it leaves the interval."""
    eye, shift = np.eye(len(v)), (lo + hi) / 2
    x = np.cos(np.arange(len(v)) * 1.7 + 0.3)  # two steps of inverse iteration from any start, then the quotient
    for step in range(60):
        x = x - found @ (found.T @ x)
        x = solved(v - shift * eye, x / np.linalg.norm(x), tiny)
        x /= np.linalg.norm(x)
        quotient = x @ v @ x
        if np.linalg.norm(v @ x - quotient * x) <= 4 * tiny:
            return (quotient, x) if lo - tiny <= quotient <= hi + tiny else None
        if step >= 1:
            if not lo <= quotient <= hi:
                return None
            shift = quotient
    return None


def cluster(v: np.ndarray, middle: float, m: int, tiny: float, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """m eigenpairs about ``middle`` that counts can't part: block inverse iteration beside them, then Rayleigh-Ritz."""
    d = len(v)
    x = np.cos(np.outer(np.arange(d) + 1.0, np.arange(1, m + 1)) * 1.3 + 0.7)
    for _ in range(8):
        x = np.linalg.qr(x - found @ (found.T @ x))[0]
        x = solved(v - (middle + 16 * tiny) * np.eye(d), x, tiny)
    x = np.linalg.qr(x - found @ (found.T @ x))[0]
    return np.diag(x.T @ v @ x).copy(), x


def leading_pairs(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    d = len(v)
    most = min(most, d)
    spread = np.abs(v).sum(axis=1)  # Gershgorin
    tiny = float(spread.max(initial=0.0)) * np.finfo(float).eps * max(4, d**0.5)
    if not tiny:
        return np.zeros(most), np.eye(d)[:, :most]
    top, bottom = float(spread.max()) + tiny, -float(spread.max()) - tiny
    counts = {top: 0, bottom: d}
    values, vectors = [], np.empty((d, 0))

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(v, shift)
        return counts[shift]

    while len(values) < most:
        k = len(values) + 1
        lo = max(s for s, c in counts.items() if c >= k)
        hi = min(s for s, c in counts.items() if c < k)
        pair = None
        while hi - lo > 8 * tiny:
            alone = count(lo) == k and count(hi) == k - 1
            pair = rayleigh(v, lo, hi, tiny, vectors) if alone else None
            if pair and count(pair[0] - 8 * tiny) == k and count(pair[0] + 8 * tiny) == k - 1:
                break  # certified: exactly k - 1 eigenvalues above, and this one
            pair = None
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if count(middle) >= k else (lo, middle)
        if pair:
            x = pair[1] - vectors @ (vectors.T @ pair[1])  # matters between very close eigenvalues only
            values.append(pair[0])
            vectors = np.column_stack([vectors, x / np.linalg.norm(x)])
        else:  # what is left in a sliver is one cluster
            m = max(1, count(lo - 8 * tiny) - len(values))
            found, block = cluster(v, (lo + hi) / 2, m, tiny, vectors)
            values.extend(found.tolist())
            vectors = np.column_stack([vectors, block])
    order = np.argsort(-np.array(values), kind="stable")[:most]
    vectors = vectors[:, order]
    strongest = vectors[np.abs(vectors).argmax(axis=0), np.arange(most)]
    return np.array(values)[order], vectors * np.where(strongest < 0, -1.0, 1.0)


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    valid = valid_vectors(vectors, vec_id, embedding)
    dims = valid.agg(F.max(F.size("vector"))).first()[0] or 0
    n, total = sums(valid, dims) if dims else (0, [])
    if not n:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    centre = Centre(n, total)
    v = covariance(valid, dims, centre)
    v = (v + v.T) / 2
    values, basis = leading_pairs(v, most)
    trace = float(np.trace(v))
    real = values > np.abs(v).sum(axis=1).max() * np.finfo(float).eps * max(4, dims)
    basis = basis / np.sqrt(np.where(real, values, 1.0))
    explained = [float(x) / trace if trace > 0 else None for x in values]
    error = None
    if real.any():
        measured = covariance(valid, dims, centre, basis[:, real])
        error = float(np.abs(measured - np.eye(len(measured))).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(values)
        for batch in batches:
            for ids, x in entries(batch, dims):
                count = len(x)
                white = centre.centred(x) @ basis
                deviation = pa.array(centre.deviations(x), pa.int64())
                spot = np.repeat(np.arange(count), size)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(spot)), pa.array(np.tile(np.arange(1, size + 1), count), pa.int32()),
                    pa.array(np.full(len(spot), n)), deviation.take(pa.array(spot)),
                    pa.array(white.ravel(), mask=~np.tile(real, count)), pa.array(explained * count, pa.float64()),
                    pa.array([error] * len(spot), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return valid.mapInArrow(rows, _RESULT)


def whitening_report(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
