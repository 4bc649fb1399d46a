"""Sieves: bitmaps of hashed keys, sent to the tasks, that drop rows before a shuffle join.

A key's 64-bit hash names a block of ``BLOCK_BITS`` bits and two bits in it. A row
whose bits are not both set has no partner and need not move; a row that passes by
chance finds none in the join, so results never depend on a sieve. The number of
blocks follows the number of keys up to ``MAX_BYTES``: beyond it more rows pass by
chance. Rows meet their block in a broadcast equi-join; tasks that work on Arrow
batches ask the bits themselves (:class:`Bits`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768    # one of Spark's bitmaps
BITS_A_KEY = 16
MAX_BYTES = 8 * 1024 * 1024


@dataclass
class Bits:
    """A sieve's bits for use inside tasks: a row of bytes for each block."""

    rows: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be a key's."""
        block = np.mod(h, len(self.rows)) if len(self.rows) > 1 else np.zeros(len(h), dtype=np.int64)
        flat, found = self.rows.reshape(-1), None
        for n in (30, 47):
            bit = (h >> n) & (BLOCK_BITS - 1)
            is_set = (flat[block * (BLOCK_BITS // 8) + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
            found = is_set if found is None else found & is_set
        return found


class Sieve:
    """A sieve of the column ``h`` of ``hashes``, for about ``n_keys`` different keys."""

    def __init__(self, hashes: DataFrame, n_keys: int, max_bytes: int = MAX_BYTES):
        self.blocks = max(1, min(-(-BITS_A_KEY * n_keys // BLOCK_BITS), max_bytes * 8 // BLOCK_BITS))
        h = F.col("h")
        rows = (hashes.select(self._block(h).alias("block"), F.explode(F.array(*self._bits(h))).alias("bit"))
                .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
        words = [np.frombuffer(bytes(r["bits"]), dtype="<i8") for r in rows]  # a bitmap counts from the lowest bit of its first byte
        table = pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "words": pa.array(words, pa.list_(pa.int64()))})
        self.bits = Bits(np.zeros((self.blocks, BLOCK_BITS // 8), dtype=np.uint8))
        for r in rows:
            self.bits.rows[r["block"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        self.table = F.broadcast(hashes.sparkSession.createDataFrame(table))

    @classmethod
    def of(cls, hashes: DataFrame, n_keys: int, max_bytes: int) -> Sieve | None:
        """A sieve of at most ``max_bytes``; none if not even one block may be sent."""
        size = min(max_bytes, MAX_BYTES)
        return cls(hashes, n_keys, size) if size * 8 >= BLOCK_BITS else None

    def _block(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.blocks).cast("bigint"))

    @staticmethod
    def _bits(h: Column) -> list[Column]:
        return [F.shiftrightunsigned(h, n).bitwiseAND(F.lit(BLOCK_BITS - 1)) for n in (30, 47)]

    def keep(self, df: DataFrame, h: Column) -> DataFrame:
        """The rows of ``df`` whose hash may be a key's."""
        def is_set(bit: Column) -> Column:
            return F.getbit(F.get("words", F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1

        first, second = self._bits(h)
        return (df.join(self.table, (self._block(h) == F.col("block")) & is_set(first) & is_set(second))
                .select(*df.columns))
